"""The order of a person's codes in time."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prevalo.functions import match_codes, normalise_codes
from prevalo.operators.cohort import PERSON, _reduce
from prevalo.operators.diagnoses import is_confirmed


def code_sequences(diagnoses: DataFrame, *, confirmed_only: bool = True) -> DataFrame:
    """Each person's codes in the order of their first years, then by code: N_CODES and SEQUENCE, an array of (BJAHR, ICD_CODE).

    Diagnoses are reduced to a first year for each code before they are collected, so an array has at most an
    entry for each code of the catalogue, however many rows a person has.
    """
    events = diagnoses.filter(is_confirmed()) if confirmed_only else diagnoses
    first = _reduce(events.filter("BJAHR IS NOT NULL AND ICD_CODE IS NOT NULL"), PERSON, "first_year")
    found = first.groupBy(*PERSON).agg(F.array_sort(F.collect_list(F.struct("BJAHR", "ICD_CODE"))).alias("SEQUENCE"))
    return found.select(*PERSON, F.size("SEQUENCE").alias("N_CODES"), "SEQUENCE")


def transitions(sequences: DataFrame, within: int) -> DataFrame:
    """Persons in whom one code came first and the other in a later year, at most ``within`` years on: CODE, LATER_CODE, N_PERSONS.

    Pairs are formed inside a person's array, without a self-join, and counted map-side.
    """
    later = F.transform(
        "SEQUENCE",
        lambda a: F.transform(
            F.filter("SEQUENCE", lambda b: (b["BJAHR"] > a["BJAHR"]) & (b["BJAHR"] <= a["BJAHR"] + within)),
            lambda b: F.struct(a["ICD_CODE"].alias("CODE"), b["ICD_CODE"].alias("LATER_CODE")),
        ),
    )
    return sequences.select(F.explode(F.flatten(later)).alias("X")).groupBy("X.CODE", "X.LATER_CODE").agg(F.count("*").alias("N_PERSONS"))


def followed_by(
    diagnoses: DataFrame,
    first: str | Iterable[str],
    then: str | Iterable[str],
    within: int,
    *,
    exact: bool = True,
    confirmed_only: bool = True,
) -> DataFrame:
    """Persons with a code of ``first`` and, one to ``within`` years later, a code of ``then``: the earliest such FIRST_YEAR and the THEN_YEAR next to it.

    Two sorted arrays of years for each person, which hold no more entries than there are years.
    """
    if within < 1:
        raise ValueError("the later code follows in a later year")
    events = diagnoses.filter(is_confirmed()) if confirmed_only else diagnoses
    one, two = (match_codes(F.col("ICD_CODE"), normalise_codes(c), exact) for c in (first, then))
    years = events.filter(one | two).groupBy(*PERSON).agg(
        F.array_sort(F.collect_set(F.when(one, F.col("BJAHR")))).alias("A"), F.array_sort(F.collect_set(F.when(two, F.col("BJAHR")))).alias("B")
    )
    pairs = F.flatten(
        F.transform("A", lambda a: F.transform(F.filter("B", lambda b: (b > a) & (b <= a + within)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    found = years.select(*PERSON, F.get(pairs, F.lit(0)).alias("P")).filter("P IS NOT NULL")
    return found.select(*PERSON, F.col("P.a").alias("FIRST_YEAR"), F.col("P.b").alias("THEN_YEAR"))
