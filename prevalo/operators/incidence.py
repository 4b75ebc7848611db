"""Incident and prevalent cases, episodes, and incidence."""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prevalo.functions import match_codes, normalise_codes
from prevalo.operators.cohort import PERSON, _reduce
from prevalo.operators.diagnoses import is_confirmed
from prevalo.operators.intervals import person_quarters, quarter_number

INCIDENT, PREVALENT, UNOBSERVED = "INCIDENT", "PREVALENT", "UNOBSERVED"


def _years(diagnoses: DataFrame, codes: str | Iterable[str] | None, exact: bool, confirmed_only: bool, key: Sequence[str]) -> DataFrame:
    events = diagnoses.filter(is_confirmed()) if confirmed_only else diagnoses
    if codes is not None:
        events = events.filter(match_codes(F.col("ICD_CODE"), normalise_codes(codes), exact))
    return _reduce(events, key, "distinct").filter("BJAHR IS NOT NULL")


def _since(key: Sequence[str]) -> Column:
    """Years since the diagnosis before, NULL for the first."""
    return F.col("BJAHR") - F.lag("BJAHR").over(Window.partitionBy(*key, "ICD_CODE").orderBy("BJAHR"))


def classify_cases(
    diagnoses: DataFrame,
    washout: int,
    versq: DataFrame | None = None,
    *,
    codes: str | Iterable[str] | None = None,
    exact: bool = True,
    confirmed_only: bool = True,
    key: Sequence[str] = PERSON,
) -> DataFrame:
    """Every key, code and diagnosis year with YEARS_SINCE the diagnosis before and a CASE_TYPE.

    A year is PREVALENT if the code was there in one of the ``washout`` years before, else INCIDENT. With ``versq`` a case
    can only be incident if the key was insured in every quarter of the washout period; it is UNOBSERVED
    otherwise, as nobody could have seen an earlier diagnosis.

    Cases and insured quarters share one shuffle by key: the lag runs over a key's codes, and a bounded RANGE frame
    counts the quarters behind each case. Both tables are reduced first, so a key has at most a row for each code and year
    and for each quarter.
    """
    if washout < 1:
        raise ValueError("a washout period is at least a year")
    years = _years(diagnoses, codes, exact, confirmed_only, key)
    columns = [*key, "ICD_CODE", "BJAHR"]
    before = F.when(F.col("YEARS_SINCE") <= washout, PREVALENT)
    if versq is None:
        return years.withColumn("YEARS_SINCE", _since(key)).select(*columns, "YEARS_SINCE", before.otherwise(INCIDENT).alias("CASE_TYPE"))
    quarters = versq.select(*key, quarter_number(F.col("VERSQ")).alias("Q")).filter("Q IS NOT NULL").distinct()
    both = years.withColumn("Q", F.col("BJAHR") * 4).unionByName(quarters.withColumn("INSURED", F.lit(1)), allowMissingColumns=True)
    behind = Window.partitionBy(*key).orderBy("Q").rangeBetween(-4 * washout, -1)
    seen = both.repartition(*key).withColumn("SEEN", F.count("INSURED").over(behind)).withColumn("YEARS_SINCE", _since(key))
    kind = before.when(F.col("SEEN") < 4 * washout, UNOBSERVED).otherwise(INCIDENT)
    return seen.filter("INSURED IS NULL").select(*columns, "YEARS_SINCE", kind.alias("CASE_TYPE"))


def episodes(
    diagnoses: DataFrame,
    max_gap: int,
    *,
    codes: str | Iterable[str] | None = None,
    exact: bool = True,
    confirmed_only: bool = True,
    key: Sequence[str] = PERSON,
) -> DataFrame:
    """Runs of diagnosis years of a code: EPISODE (1, 2, ...), FIRST_YEAR, LAST_YEAR, N_YEARS with a diagnosis.

    An episode is closed by more than ``max_gap`` years without a diagnosis.
    """
    if max_gap < 0:
        raise ValueError("a gap can't be negative")
    years = _years(diagnoses, codes, exact, confirmed_only, key).withColumn("YEARS_SINCE", _since(key))
    order = Window.partitionBy(*key, "ICD_CODE").orderBy("BJAHR")
    goes_on = F.col("YEARS_SINCE") <= max_gap + 1
    numbered = years.withColumn("EPISODE", F.sum(F.when(goes_on, 0).otherwise(1)).over(order).cast("int"))
    return numbered.groupBy(*key, "ICD_CODE", "EPISODE").agg(
        F.min("BJAHR").alias("FIRST_YEAR"), F.max("BJAHR").alias("LAST_YEAR"), F.count("*").alias("N_YEARS")
    )


def incidence(cases: DataFrame, versq: DataFrame) -> DataFrame:
    """Per code and year: incident, prevalent and unobserved persons, the person-quarters insured in the year, and incident cases per 1000
    person-years. Cases by contract count their persons once: a person is incident only if none of the contracts is prevalent."""
    order = F.min(F.when(F.col("CASE_TYPE") == PREVALENT, 0).when(F.col("CASE_TYPE") == UNOBSERVED, 1).otherwise(2)).alias("KIND")
    persons = cases.groupBy("PSID", "ICD_CODE", "BJAHR").agg(order)
    counts = persons.groupBy("ICD_CODE", "BJAHR").agg(
        F.count_if(F.col("KIND") == 2).alias("N_INCIDENT"),
        F.count_if(F.col("KIND") == 0).alias("N_PREVALENT"),
        F.count_if(F.col("KIND") == 1).alias("N_UNOBSERVED"),
    )
    rate = F.col("N_INCIDENT") * F.lit(4000.0) / F.col("PERSON_QUARTERS")
    joined = counts.join(person_quarters(versq).drop("N_PERSONS"), "BJAHR", "left")
    return joined.select("ICD_CODE", "BJAHR", "N_INCIDENT", "N_PREVALENT", "N_UNOBSERVED", "PERSON_QUARTERS", rate.alias("PER_1000_PERSON_YEARS"))
