"""Exact ranks, tiles and quantiles of large tables."""

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prevalo.sources.staging import stage


def ranked(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> tuple[DataFrame, int]:
    """The rows with RANK, their place in the ascending order (NULL first) from 1, and the number of rows.

    A window without a partition would bring all rows into one task. Instead rows go to ranges of the order, and a
    row's rank is its place in its range plus the rows of all ranges before. Ranges are stored, so that they stay as
    they are; only their sizes reach the driver. Add a unique column to the order: rows that are equal in all
    columns share a range.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(df.repartitionByRange(ranges, *order).withColumn("__RANGE", F.spark_partition_id()), "ranges")
    sizes = sorted((r["__RANGE"], r["count"]) for r in dealt.groupBy("__RANGE").count().collect())
    before, offsets = 0, []
    for number, size in sizes:
        offsets.append((number, before))
        before += size
    behind = spark.createDataFrame(offsets, "__RANGE int, __BEFORE long")
    within = F.row_number().over(Window.partitionBy("__RANGE").orderBy(*order))
    out = dealt.withColumn("__PLACE", within).join(behind, "__RANGE").withColumn("RANK", F.col("__PLACE") + F.col("__BEFORE"))
    return out.select(*df.columns, "RANK"), before


def tiles(df: DataFrame, order: Sequence[str], n: int, ranges: int | None = None) -> DataFrame:
    """The rows with TILE, from 1 to ``n``: tiles of equal size in the order, the first ones a row larger if they don't come out even."""
    if n < 1:
        raise ValueError("at least one tile")
    rows, total = ranked(df, order, ranges)
    size, larger = divmod(total, n)
    edge, place = larger * (size + 1), F.col("RANK") - 1
    tile = F.when(place < edge, F.floor(place / (size + 1))).otherwise(larger + F.floor((place - edge) / max(size, 1))) + 1
    return rows.select(*df.columns, tile.cast("int").alias("TILE"))


def quantiles(df: DataFrame, value: str, unique: Sequence[str], shares: Sequence[float], ranges: int | None = None) -> DataFrame:
    """SHARE and the smallest value that at least this share of the known values doesn't exceed: exact, never between two values.

    ``unique`` tells equal values apart. Only the wanted ranks are looked up, so one row for each share is left.
    """
    if not all(0 <= s <= 1 for s in shares):
        raise ValueError("shares are from 0 to 1")
    rows, total = ranked(df.filter(F.col(value).isNotNull()).select(value, *unique), [value, *unique], ranges)
    places = [(float(s), max(1, math.ceil(Fraction(str(s)) * total))) for s in shares]
    wanted = df.sparkSession.createDataFrame(places, "SHARE double, RANK long")
    return rows.join(wanted, "RANK").select("SHARE", value)
