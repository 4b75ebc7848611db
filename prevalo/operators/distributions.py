"""Age × sex frequency tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _weight(demo: DataFrame) -> Column:
    """Diagnosis rows behind one row: N_ROWS when the frame was reduced, else one."""
    return F.sum("N_ROWS") if "N_ROWS" in demo.columns else F.count("PSID")


def age_sex_distribution(
    demo: DataFrame, by: Sequence[str] = ("ICD_CODE", "BJAHR"), measure: str = "rows"
) -> DataFrame:
    """Counts per ``by``, ALTERSGRUPPE and GESCHLECHT_LABEL.

    ``measure``: ``rows`` counts the cohort rows, ``persons`` distinct persons, and
    ``person_years`` a person once for each year.
    """
    groups = [*by, "ALTERSGRUPPE", "GESCHLECHT_LABEL"]
    labelled = demo.withColumnRenamed("AGE_GROUP", "ALTERSGRUPPE")
    if measure == "rows":
        counted = labelled.groupBy(*groups).agg(_weight(labelled).alias("CNT_D_PSID"))
    elif measure == "persons":
        counted = labelled.groupBy(*groups).agg(F.count_distinct("PSID").alias("CNT_D_PSID"))
    elif measure == "person_years":
        # Distinct persons per year, added up over the years, is the number of distinct
        # (person, year) pairs: one distinct and one count instead of nested aggregations.
        pairs = labelled.select(*dict.fromkeys([*groups, "BJAHR", "PSID"])).distinct()
        counted = pairs.groupBy(*groups).agg(F.count("PSID").alias("CNT_D_PSID"))
    else:
        raise ValueError(f"unknown measure {measure!r}")
    return counted


def age_sex_case_control(
    demo_cases: DataFrame, demo_rest: DataFrame, rest_tag: str, measure: str = "person_years"
) -> DataFrame:
    """Cases by code and the rest under one tag, counted in one aggregation."""
    columns = ["PSID", "ICD_CODE", "BJAHR", "AGE_GROUP", "GESCHLECHT_LABEL"]
    rest = demo_rest.withColumn("ICD_CODE", F.lit(rest_tag)).select(*columns)
    both = demo_cases.select(*columns).unionByName(rest)
    known = both.filter(F.col("AGE_GROUP").isNotNull() & F.col("GESCHLECHT_LABEL").isNotNull())
    return age_sex_distribution(known, by=("ICD_CODE",), measure=measure)


def totals(distribution: DataFrame, by: Sequence[str], name: str = "TOTAL") -> DataFrame:
    """Counts of a frequency table added up over everything but ``by``."""
    return distribution.groupBy(*by).agg(F.sum("CNT_D_PSID").alias(name))


def top_totals(distribution: DataFrame, by: str, n: int = 10, name: str = "TOTAL") -> DataFrame:
    """The ``n`` largest totals; equal totals are ordered by ``by``."""
    return totals(distribution, [by], name).orderBy(F.desc(name), by).limit(n)
