"""Postcode frequency tables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prevalo.constants import SEX_LABELS


def _area(digits: int | None):
    return F.col("PLZ") if digits is None else F.substring("PLZ", 1, digits)


def plz_distribution(demo: DataFrame, digits: int | None = 1, by: Sequence[str] = (), name: str = "PLZ") -> DataFrame:
    """Distinct persons per postcode area; missing and blank postcodes stay as groups."""
    return demo.groupBy(*by, _area(digits).alias(name)).agg(F.count_distinct("PSID").alias("CNT_D_PSID"))


def plz_case_control(
    demo_cases: DataFrame, demo_rest: DataFrame, digits: int | None = None, case_tag: str = "OI"
) -> DataFrame:
    """Persons per postcode by group and sex, with their total.

    Both groups go through one distinct and one aggregation over their union: a postcode
    of either side gets a row, an absent side counts zero, and no outer join is needed.
    """
    parts = []
    for tag, demo in ((case_tag, demo_cases), ("REMAIN", demo_rest)):
        parts.append(demo.select("PSID", _area(digits).alias("PLZ"), "GESCHLECHT_LABEL", F.lit(tag).alias("PART")))
    both = parts[0].unionByName(parts[1]).filter(F.col("PLZ").isNotNull() & (F.col("PLZ") != ""))
    persons = both.distinct()

    def in_cell(tag: str, label: str):
        return (F.col("PART") == tag) & (F.col("GESCHLECHT_LABEL") == label)

    cells = {
        f"CNT_D_PSID_{tag}_{label[0]}": F.count_if(in_cell(tag, label))
        for tag in (case_tag, "REMAIN")
        for label in SEX_LABELS.values()
    }
    counted = persons.groupBy("PLZ").agg(*(count.alias(name) for name, count in cells.items()))
    total = sum((F.col(name) for name in cells), F.lit(0))
    return counted.select("PLZ", total.cast("long").alias("CNT_D_PSID_TOTAL"), *cells)


def plz_list(demo: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per group with the sorted list of their different postcodes.

    The list is bounded by the number of postcodes, not by the number of persons.
    """
    rows = F.sum("N_ROWS") if "N_ROWS" in demo.columns else F.count("PSID")
    areas = F.collect_set("PLZ")
    listed = F.when(F.size(areas) > 0, F.array_join(F.array_sort(areas), ","))
    return demo.groupBy(*by).agg(rows.alias("CNT_D_PSID"), listed.alias("PLZ"))
