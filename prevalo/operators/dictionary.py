"""Data dictionary of the multi-code report."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prevalo.constants import (
    DICTIONARY_COLUMNS,
    DICTIONARY_SUBJECT,
    DICTIONARY_TABLES,
    FREQUENCY_TABLE,
    INCLUSION_TEXT,
)


def table_entries(codes: DataFrame, min_share: float = 0.10, top_n: int = 20) -> DataFrame:
    """One entry per result table, naming the codes; in POS order when the list has one.

    ``min_share`` and ``top_n`` are those of the report that the entries describe.

    The gathered list is bounded by the code catalogue.
    """
    order = F.col("POS") if "POS" in codes.columns else F.lit(0)
    listed = F.array_sort(F.collect_set(F.struct(order.alias("pos"), F.col("ICD_CODE").alias("code"))))
    text = codes.agg(F.array_join(F.transform(listed, lambda item: item["code"]), ", ").alias("codes"))
    percent = round(100 * min_share, 6)
    texts = [(name, text.format(top_n=top_n, percent=percent)) for name, text in DICTIONARY_TABLES]
    entries = F.explode(
        F.array(*(F.struct(F.lit(t).alias("name"), F.lit(d).alias("text")) for t, d in texts))
    )
    return text.select("codes", entries.alias("entry")).select(
        F.col("entry.name").alias("TABELLENNAME"),
        F.lit(DICTIONARY_SUBJECT).alias("KLASSIFIKATION_VERSICHERTENBEZUG_LEISTUNGSTRAEGERBEZUG"),
        F.lit(FREQUENCY_TABLE).alias("KLASSIFIKATION_STATISTISCH"),
        F.concat("entry.text", "codes").alias("BESCHREIBUNG"),
        F.concat(F.lit(INCLUSION_TEXT), F.col("codes")).alias("EINSCHLUSS_FILTERKRITERIEN"),
    )


def column_entries(spark: SparkSession) -> DataFrame:
    """One entry per column of the result tables."""
    names = ("TABELLENNAME", "KLASSIFIKATION_STATISTISCH", "SPALTENNAME", "BESCHREIBUNG")
    return spark.createDataFrame(DICTIONARY_COLUMNS, ", ".join(f"{n} string" for n in names))
