"""Cohorts and the remaining population."""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prevalo.functions import match_codes, normalise_codes
from prevalo.operators.diagnoses import is_confirmed

PERSON = ("PSID",)
CONTRACT = ("PSID", "VSID")


def _reduce(events: DataFrame, key: Sequence[str], grain: str) -> DataFrame:
    """Collapse diagnosis rows before anything is shuffled with another table.

    Every grain combines map-side, so one person with a large share of all rows leaves
    each task as no more rows than there are codes and years.
    """
    if grain == "first_year":
        return events.groupBy(*key, "ICD_CODE").agg(F.min("BJAHR").alias("BJAHR"))
    full = [*key, "ICD_CODE", "BJAHR"]
    if grain == "distinct":
        return events.select(*full).distinct()
    if grain == "per_source":
        return events.select(*full, "SRC").distinct().drop("SRC")
    if grain == "rows":
        return events.groupBy(*full).agg(F.count(F.lit(1)).alias("N_ROWS"))
    raise ValueError(f"unknown grain {grain!r}")


def for_persons(df: DataFrame, persons: DataFrame, on: Sequence[str] = PERSON) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``persons``."""
    return df.join(persons.select(*on), list(on), "left_semi")


def cohort(
    diagnoses: DataFrame,
    codes: str | Iterable[str],
    *,
    exact: bool = True,
    secondary: bool = False,
    relabel: bool = False,
    confirmed_only: bool = True,
    key: Sequence[str] = PERSON,
    grain: str = "first_year",
) -> DataFrame:
    """Persons with any of the codes: ``key``, ICD_CODE, BJAHR.

    ``secondary`` also matches the secondary inpatient code; such rows keep their primary
    code unless ``relabel`` puts the matching code in its place. ``grain`` is
    ``first_year`` (earliest year per key and code), ``distinct`` (every year),
    ``per_source`` (every year, once per diagnosis source) or ``rows`` (with N_ROWS).
    """
    wanted = normalise_codes(codes)
    primary = match_codes(F.col("ICD_CODE"), wanted, exact)
    hit = primary
    if secondary:
        hit = hit | match_codes(F.col("SEK_CODE"), wanted, exact)
    events = diagnoses.filter(hit & is_confirmed()) if confirmed_only else diagnoses.filter(hit)
    if secondary and relabel:
        events = events.withColumn("ICD_CODE", F.when(primary, F.col("ICD_CODE")).otherwise(F.col("SEK_CODE")))
    return _reduce(events, key, grain)


def cohort_for_list(
    diagnoses: DataFrame,
    code_list: DataFrame,
    *,
    exact: bool = True,
    secondary: bool = False,
    confirmed_only: bool = True,
    key: Sequence[str] = PERSON,
    grain: str = "first_year",
) -> DataFrame:
    """One cohort per code of a code list, all in one pass over the diagnoses.

    A list that is small enough to broadcast (give it staged, so that its size is exact)
    filters the scan, below the aggregation; a larger one meets rows that are reduced
    already.

    Without ``exact`` a listed code also stands for all that start with it, and with
    ``secondary`` the secondary inpatient code counts too. Then a row can belong to several
    listed codes, and LISTED_CODE names the one it is counted for; ICD_CODE stays the row's
    own primary code. Rows meet the list by the left parts of their codes, of the lengths that the
    list has: an equality join, whose work per row doesn't grow with the list.
    """
    events = diagnoses.filter(is_confirmed()) if confirmed_only else diagnoses
    listed = code_list.select("ICD_CODE")
    if exact and not secondary:
        reduced = _reduce(events, key, grain)
        return reduced.join(listed, "ICD_CODE", "left_semi").select(*reduced.columns)
    codes = ["ICD_CODE", "SEK_CODE"] if secondary else ["ICD_CODE"]
    if exact:
        parts = [F.col(c) for c in codes]
    else:
        # Bounded: codes have a handful of lengths.
        lengths = [r[0] for r in listed.select(F.length("ICD_CODE")).distinct().collect()]
        parts = [F.when(F.length(c) >= n, F.substring(c, 1, n)) for c in codes for n in lengths]
    named = events.withColumn("LISTED_CODE", F.explode(F.array_distinct(F.array_compact(F.array(*parts)))))
    named = named.join(listed.withColumnRenamed("ICD_CODE", "LISTED_CODE"), "LISTED_CODE", "left_semi")
    return _reduce(named, [*key, "LISTED_CODE"], grain)


def cohort_size(members: DataFrame) -> DataFrame:
    """Number of distinct persons, as a one-row table."""
    return members.agg(F.count_distinct("PSID").alias("N_PERSONS"))


def share_of_persons(members: DataFrame, share: float) -> Column:
    """``share`` of the distinct persons, as a scalar subquery."""
    return members.agg((F.count_distinct("PSID") * F.lit(float(share))).alias("MINIMUM")).scalar()


def remaining(
    diagnoses: DataFrame,
    members: DataFrame,
    *,
    confirmed_only: bool = True,
    key: Sequence[str] = CONTRACT,
    grain: str = "first_year",
) -> DataFrame:
    """Diagnoses of everyone outside the cohort, excluded by person whatever the key.

    Reduced first, then anti-joined. When ``members`` is small enough to broadcast,
    Catalyst moves the anti-join below the aggregation; otherwise only reduced rows move.
    """
    events = diagnoses.filter(is_confirmed()) if confirmed_only else diagnoses
    reduced = _reduce(events, key, grain)
    return reduced.join(members.select("PSID"), "PSID", "left_anti").select(*reduced.columns)


def contract_years(members: DataFrame, partitioned: bool = False) -> DataFrame:
    """Distinct person, contract and year, for tables in which the code plays no part.

    Partitioning by contract up front lets the distinct and the join with the master
    tables share one shuffle (the last of three: reduction and anti-join come before it).
    ``partitioned`` members, staged in buckets by contract, need none.
    """
    columns = ["PSID", "VSID", "BJAHR"]
    years = members.select(*columns)
    return (years if partitioned else years.repartition("PSID", "VSID")).distinct()
