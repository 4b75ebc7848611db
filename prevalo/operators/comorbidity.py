"""Comorbidities: codes that co-occur with a cohort's codes."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prevalo.constants import PLACEHOLDER_CODE
from prevalo.functions import normalise_codes
from prevalo.operators.cohort import for_persons, share_of_persons


def comorbidities(
    diagnoses: DataFrame,
    members: DataFrame,
    exclude: str | Iterable[str],
    *,
    min_share: float = 0.10,
    top_n: int = 20,
    threshold_scope: str = "cohort",
) -> DataFrame:
    """Most frequent other codes per base code and year, with their dense rank RN.

    A code needs ``min_share`` of all cohort persons (``threshold_scope="cohort"``) or of
    the persons with that base code in that year (``"base_year"``). Ties share a rank, so
    more than ``top_n`` codes may remain.
    """
    base = members.select("PSID", "BJAHR", F.col("ICD_CODE").alias("ICDAMB_CODE_BASE")).distinct()
    others = (
        diagnoses.filter(~F.col("ICD_CODE").isin(*normalise_codes(exclude), PLACEHOLDER_CODE))
        .select("PSID", "BJAHR", F.col("ICD_CODE").alias("ICDAMB_CODE_COMORBID"))
        .distinct()
    )
    # The semi-join is what can move below the distinct when the cohort is small.
    linked = for_persons(others, members, ["PSID", "BJAHR"]).join(base, ["PSID", "BJAHR"])
    # Both sides are distinct, so each row is one person: a plain count is a distinct count.
    counted = linked.groupBy("ICDAMB_CODE_BASE", "BJAHR", "ICDAMB_CODE_COMORBID").agg(
        F.count("PSID").alias("CNT_D_PSID")
    )
    if threshold_scope == "cohort":
        frequent = counted.filter(F.col("CNT_D_PSID") >= F.ceil(share_of_persons(members, min_share)))
    elif threshold_scope == "base_year":
        size = F.ceil(F.count("PSID") * F.lit(float(min_share)))
        sizes = base.groupBy("ICDAMB_CODE_BASE", "BJAHR").agg(size.alias("MINIMUM"))
        frequent = (
            counted.join(sizes, ["ICDAMB_CODE_BASE", "BJAHR"])
            .filter(F.col("CNT_D_PSID") >= F.col("MINIMUM"))
            .drop("MINIMUM")
        )
    else:
        raise ValueError(f"unknown threshold scope {threshold_scope!r}")
    # Ranks the small table of counts, at most one row per code in each window.
    ranks = Window.partitionBy("ICDAMB_CODE_BASE", "BJAHR").orderBy(F.desc("CNT_D_PSID"))
    ranked = frequent.withColumn("RN", F.dense_rank().over(ranks)).filter(F.col("RN") <= top_n)
    return ranked.select("ICDAMB_CODE_BASE", "BJAHR", "ICDAMB_CODE_COMORBID", "CNT_D_PSID", "RN")


def comorbidity_row_counts(
    diagnoses: DataFrame, persons: DataFrame, code: str, *, min_share: float = 0.10, column: str = "ICDAMB_CODE"
) -> DataFrame:
    """Diagnosis rows per other code of the given persons, any year.

    A code is kept from ``min_share`` × persons rows on; rows, not persons, are counted.
    """
    per_person = diagnoses.groupBy("PSID", "ICD_CODE").agg(F.count(F.lit(1)).alias("N_ROWS"))
    rows = for_persons(per_person, persons).groupBy("ICD_CODE").agg(F.sum("N_ROWS").alias("n"))
    frequent = F.col("n") >= share_of_persons(persons, min_share)
    others = ~F.col("ICD_CODE").isin(code, PLACEHOLDER_CODE)
    return rows.filter(others & frequent).select(F.col("ICD_CODE").alias(column), "n")


def _labels(labels: DataFrame, years: Iterable[int], column: str) -> DataFrame:
    """One label per code: that of the latest of the wanted catalogue years."""
    wanted = labels.filter(F.col("year").isin(*years))
    return wanted.groupBy(F.col("icd_sub").alias(column)).agg(F.max_by("label", "year").alias("label"))


def top_labelled(
    counts: DataFrame, labels: DataFrame, years: Iterable[int], n: int = 20, column: str = "ICDAMB_CODE"
) -> DataFrame:
    """The ``n`` most frequent codes with their labels; ties are ordered by code."""
    top = counts.orderBy(F.desc("n"), column).limit(n)
    return top.join(_labels(labels, years, column), column, "left").select(column, "n", "label")


def labelled_codes(
    counts: DataFrame, labels: DataFrame, years: Iterable[int], column: str = "ICDAMB_CODE"
) -> DataFrame:
    """Every counted code with its label, as ICD_codes, n, label."""
    joined = counts.join(_labels(labels, years, column), column, "left")
    return joined.select(F.col(column).alias("ICD_codes"), "n", "label")
