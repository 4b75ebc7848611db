"""The data behind the single-code charts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prevalo.functions import histogram_bin
from prevalo.operators.demographics import person_demographics


def diagnosis_counts(diagnoses: DataFrame) -> DataFrame:
    """Persons with a diagnosis and how many diagnosis rows (N_ROWS) each has."""
    return diagnoses.groupBy("PSID").agg(F.count(F.lit(1)).alias("N_ROWS"))


def diagnosed_persons(
    counts: DataFrame, vers: DataFrame, versq: DataFrame, reference_year: int | None = None
) -> DataFrame:
    """Diagnosed persons with N_ROWS and their demographics; ``counts`` should be staged."""
    return counts.join(person_demographics(vers, versq, reference_year, counts), "PSID")


def _count(dedupe: bool):
    return F.count("PSID") if dedupe else F.sum("N_ROWS")


def age_histogram(diagnosed: DataFrame, width: int = 10, dedupe: bool = False) -> DataFrame:
    """Diagnosis rows (or persons) per sex and age bin; unknown ages are left out.

    A bin holds the ages up to half a width above its centre and more than half a width
    below it. Charting libraries also close the lowest bin on the left; that is not done.
    """
    return (
        diagnosed.filter(F.col("ALTER").isNotNull())
        .groupBy("GESCHLECHT", histogram_bin(F.col("ALTER"), width).alias("AGE_BIN"))
        .agg(_count(dedupe).alias("n"))
    )


def sex_share(diagnosed: DataFrame, dedupe: bool = False) -> DataFrame:
    """Diagnosis rows (or persons) per sex with their percentage and chart label.

    Unknown sex is its own group, labelled NA. Exact ties in the label's one decimal are
    rounded up.
    """
    counts = diagnosed.groupBy("GESCHLECHT").agg(_count(dedupe).alias("n"))
    # At most three rows reach this window.
    percent = F.col("n") / F.sum("n").over(Window.partitionBy()) * 100
    text = F.format_string("%s\n%d (%.1f%%)", F.coalesce("GESCHLECHT", F.lit("NA")), "n", "percent")
    return counts.withColumn("percent", percent).withColumn("label", text)
