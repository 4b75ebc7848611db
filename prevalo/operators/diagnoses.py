"""Outpatient and inpatient diagnoses in one shape."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prevalo.constants import CONFIRMED, INPATIENT, OUTPATIENT
from prevalo.functions import exact_or_g_suffix, matches_prefix


def unified_diagnoses(ambdiag: DataFrame, khdiag: DataFrame | None = None) -> DataFrame:
    """PSID, VSID, BJAHR, ICD_CODE, SEK_CODE, DIAGSICH, SRC over both sources.

    Filters and column pruning reach the two scans through the union, and tests on the
    literal columns fold away per branch.
    """
    no_text = F.lit(None).cast("string")
    outpatient = ambdiag.select(
        "PSID",
        "VSID",
        "BJAHR",
        F.col("ICDAMB_CODE").alias("ICD_CODE"),
        no_text.alias("SEK_CODE"),
        "DIAGSICH",
        F.lit(OUTPATIENT).alias("SRC"),
    )
    if khdiag is None:
        return outpatient
    inpatient = khdiag.select(
        "PSID",
        "VSID",
        "BJAHR",
        F.col("ICDKH_CODE").alias("ICD_CODE"),
        F.col("SEKICD_CODE").alias("SEK_CODE"),
        no_text.alias("DIAGSICH"),
        F.lit(INPATIENT).alias("SRC"),
    )
    return outpatient.unionByName(inpatient)


def is_confirmed() -> Column:
    """Inpatient diagnoses carry no certainty and always count."""
    return (F.col("SRC") == INPATIENT) | (F.col("DIAGSICH") == CONFIRMED)


def filter_codes(diagnoses: DataFrame, code: str, exact: bool = False, column: str = "ICD_CODE") -> DataFrame:
    """Diagnoses of one code: by prefix, or exact with an optional trailing ``G``."""
    wanted = F.col(column)
    return diagnoses.filter(exact_or_g_suffix(wanted, code) if exact else matches_prefix(wanted, [code]))
