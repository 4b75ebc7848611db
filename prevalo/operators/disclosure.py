"""Suppression of small cells, so that published margins give none of them back."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prevalo.sources.staging import stage

PRIMARY, SECONDARY = "PRIMARY", "SECONDARY"


def with_margins(table: DataFrame, rows: str, columns: str, layers: Sequence[str] = (), value: str = "CNT_D_PSID", label: str = "ALL") -> DataFrame:
    """A frequency table with its row, column and grand totals, as rows whose category is ``label``: layers, rows, columns, value."""
    cells = _cells(table, rows, columns, layers, value)
    return cells.select(*layers, _name("R", label).alias(rows), _name("C", label).alias(columns), F.col("N").alias(value))


def _cells(table: DataFrame, rows: str, columns: str, layers: Sequence[str], value: str) -> DataFrame:
    """Layers, R and C (total: whether it is a margin; name) and N. One aggregation: a cell adds to four sums."""

    def place(total: bool, name: str) -> Column:
        named = F.lit(None).cast("string") if total else F.col(name).cast("string")
        return F.struct(F.lit(total).alias("total"), named.alias("name"))

    four = [F.struct(place(r, rows).alias("R"), place(c, columns).alias("C")) for r in (False, True) for c in (False, True)]
    known = table.filter(F.col(value).isNotNull())
    spread = known.select(*layers, F.col(value).cast("long").alias("N"), F.explode(F.array(*four)).alias("P"))
    return spread.select(*layers, "P.R", "P.C", "N").groupBy(*layers, "R", "C").agg(F.sum("N").alias("N"))


def _name(place: str, label: str) -> Column:
    return F.when(F.col(f"{place}.total"), label).otherwise(F.col(f"{place}.name"))


def suppress(
    table: DataFrame,
    rows: str,
    columns: str,
    layers: Sequence[str] = (),
    value: str = "CNT_D_PSID",
    k: int = 5,
    label: str = "ALL",
) -> DataFrame:
    """A frequency table with margins in which no count from 1 to ``k`` - 1 can be seen or calculated.

    Result: layers, ``rows``, ``columns`` (``label`` for totals), ``value`` (NULL where hidden) and HIDDEN: PRIMARY for small counts,
    margins included, SECONDARY for those that would give one back, else NULL. Each layer is a table of its own.

    Hiding a second cell of every line with one hidden is not enough: lines can be added up. Therefore each small cell
    becomes a corner of a rectangle of four hidden cells, none of which is 0. Adding 1 to two opposite corners and taking 1 from the others
    (with signs turned for margins) changes no published number and no count below 0, so every hidden cell can have
    at least two values. A margin counts as one more row or column, so a rectangle always exists; it is chosen to hide
    as few margins as possible, then as few persons, then by names.

    For a small cell and each other column, the best other row is one of the best two for that pair of columns, whichever row the cell
    is in. So the work grows with rows x columns^2: give the longer category as ``rows``.
    """
    if k < 2:
        raise ValueError("the least count that may be seen is 2 or more")
    layers = list(layers)
    numbered = {f"L{i}": name for i, name in enumerate(layers)}
    # Layers as one value that is never NULL, so that NULL is a category like any other.
    layer = F.struct(F.lit(0).alias("all"), *[F.col(n).alias(i) for i, n in numbered.items()])
    small = F.col("N").between(1, k - 1)
    cells = _cells(table, rows, columns, layers, value).select(layer.alias("L"), "R", "C", "N", small.alias("SMALL"))
    cells = stage(cells, "cells")
    margin = (F.col("R.total") | F.col("C.total")).cast("long")
    cost = [F.when(F.col("SMALL"), 0).otherwise(x).cast("long") for x in (margin, F.col("N"))]
    usable = cells.filter("N > 0").select("L", "R", "C", "SMALL", F.struct(cost[0].alias("m"), cost[1].alias("v")).alias("COST"))

    def added(a: str, b: str) -> Column:
        return F.struct((F.col(f"{a}.m") + F.col(f"{b}.m")).alias("m"), (F.col(f"{a}.v") + F.col(f"{b}.v")).alias("v"))

    other = usable.select("L", "R", F.col("C").alias("C2"), F.col("COST").alias("COST2"))
    # Pairs of cells of a row in two columns, the first of which has a small cell somewhere.
    needed = usable.filter("SMALL").select("L", "C").distinct()
    pairs = usable.join(needed, ["L", "C"], "left_semi").join(other, ["L", "R"]).filter("C <> C2")
    order = Window.partitionBy("L", "C", "C2").orderBy("PAIR", "R")
    best = pairs.withColumn("PAIR", added("COST", "COST2")).withColumn("N", F.row_number().over(order)).filter("N <= 2")
    best = best.select("L", "C", "C2", F.col("R").alias("R2"), "PAIR")
    corners = usable.filter("SMALL").join(other, ["L", "R"]).filter("C <> C2").join(best, ["L", "C", "C2"]).filter("R <> R2")
    choice = F.min(F.struct(added("COST2", "PAIR").alias("COST"), "C2", "R2")).alias("X")
    chosen = corners.groupBy("L", "R", "C").agg(choice)
    partners = F.array(*[F.struct(F.col(r).alias("R"), F.col(c).alias("C")) for r, c in (("R", "X.C2"), ("X.R2", "C"), ("X.R2", "X.C2"))])
    hidden = chosen.select("L", F.explode(partners).alias("P")).select("L", "P.R", "P.C").distinct().withColumn("PARTNER", F.lit(True))

    found = cells.join(hidden, ["L", "R", "C"], "left")
    why = F.when(F.col("SMALL"), PRIMARY).when(F.col("PARTNER"), SECONDARY)
    return found.select(
        *[F.col(f"L.{i}").alias(n) for i, n in numbered.items()], _name("R", label).alias(rows), _name("C", label).alias(columns),
        F.when(why.isNull(), F.col("N")).alias(value), why.alias("HIDDEN"),
    )


def suppress_report(tables: dict[str, DataFrame], k: int = 5) -> dict[str, DataFrame]:
    """The tables of a report with small cells hidden: age by sex where a table has both, one category and its total otherwise.

    The remaining columns of an age and sex table are its layers. Postcode tables with counts of several groups become long, with the group
    in GROUP. Tables without counts of persons stay as they are. Each table is protected by itself: publish no
    others from the same persons and categories beside them.
    """
    return {name: _suppress_table(df, k) for name, df in tables.items()}


def _suppress_table(df: DataFrame, k: int) -> DataFrame:
    ages = [c for c in ("ALTERSGRUPPE", "AGE_GROUP") if c in df.columns]
    counts = [c for c in df.columns if c.startswith("CNT_D_PSID") and not c.endswith("_TOTAL")]
    if not counts:
        return df
    if ages and "GESCHLECHT_LABEL" in df.columns:
        layers = [c for c in df.columns if c not in (*ages, "GESCHLECHT_LABEL", *counts)]
        return suppress(df, ages[0], "GESCHLECHT_LABEL", layers, counts[0], k)
    category = [c for c in df.columns if c not in (*counts, "RN") and not c.startswith("CNT_D_PSID")]
    if len(counts) > 1:
        long = df.select(*category, F.explode(F.array(*[F.struct(F.lit(c.removeprefix("CNT_D_PSID_")).alias("GROUP"), F.col(c).alias("CNT_D_PSID")) for c in counts])).alias("X"))
        return suppress(long.select(*category, "X.*"), category[0], "GROUP", category[1:], "CNT_D_PSID", k)
    table = df.withColumn("GROUP", F.lit("PERSONS"))
    return suppress(table, category[-1], "GROUP", category[:-1], counts[0], k)
