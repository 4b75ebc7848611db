"""How many persons are in exactly which of many cohorts."""

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prevalo.functions import match_codes, normalise_codes
from prevalo.operators.cohort import PERSON
from prevalo.operators.diagnoses import is_confirmed

#: Most cohorts: there are two to this power cells.
MOST = 16


def membership(
    diagnoses: DataFrame, cohorts: Mapping[str, str | Iterable[str]], *, exact: bool = False, confirmed_only: bool = True
) -> DataFrame:
    """Every person with diagnoses and a MASK: bit i is set if the person is in cohort i.

    Each row gets the bits of the cohorts that its code belongs to, and bits are joined per person, map-side first: one pass over the
    diagnoses and one shuffle, for any number of cohorts.
    """
    if not 1 <= len(cohorts) <= MOST:
        raise ValueError(f"from 1 to {MOST} cohorts")
    events = diagnoses.filter(is_confirmed()) if confirmed_only else diagnoses
    mask = F.lit(0)
    for i, codes in enumerate(cohorts.values()):
        mask = mask + F.when(match_codes(F.col("ICD_CODE"), normalise_codes(codes), exact), 1 << i).otherwise(0)
    return events.filter("PSID IS NOT NULL").groupBy(*PERSON).agg(F.bit_or(mask).alias("MASK"))


def membership_counts(members: DataFrame, names: Iterable[str]) -> DataFrame:
    """All cells, also empty ones: a boolean for each cohort and N_PERSONS that are in exactly those."""
    names = list(names)
    counts = members.groupBy("MASK").agg(F.count("*").alias("N_PERSONS"))
    cells = members.sparkSession.range(1 << len(names)).select(F.col("id").cast("int").alias("MASK"))
    found = cells.join(counts, "MASK", "left")
    flags = [(F.col("MASK").bitwiseAND(1 << i) != 0).alias(name) for i, name in enumerate(names)]
    return found.select("MASK", *flags, F.coalesce("N_PERSONS", F.lit(0)).alias("N_PERSONS"))


def members_of(members: DataFrame, names: Iterable[str], *, inside: Iterable[str] = (), outside: Iterable[str] = ()) -> DataFrame:
    """Persons that are in all cohorts of ``inside`` and in none of ``outside``: intersections and differences without a join."""
    at = {name: 1 << i for i, name in enumerate(names)}
    wanted, refused = sum(at[n] for n in set(inside)), sum(at[n] for n in set(outside))
    fits = (F.col("MASK").bitwiseAND(wanted) == wanted) & (F.col("MASK").bitwiseAND(refused) == 0)
    return members.filter(fits).select(*PERSON)
