"""Mixing sources to target weights by Pareto order sampling.

A source that is to give r times its words gives every document floor(r) certain copies; the
rest is a fixed-size sample with inclusion probability f = r - floor(r). Documents are ranked by
random odds over inclusion odds, (u / (1 - u)) / (f / (1 - f)), with u fixed by the document's id,
and taken from the smallest rank on until the words still due are reached, to the nearest document.
A ``propensity`` column (positive; null: 1) multiplies a document's inclusion odds, for unequal
probabilities within a source as well.

All of it is DataFrame functions. Running sums are made in two steps, over ranges of u and then
within one range, so no window ever holds a source; a source with a third of all rows is as many
parallel ranges as any other. Sources are totalled before they are ordered.

Cases: a null text has size 0; a null source is a source of its own, last in order; rows with the same
doc_id and text are taken or left alike; an empty table gives an empty result. Further columns are
kept as they are, also where they clash with the operator's own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prevalo.llm.common import stage, uniform, word_count

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Ranges that each source's order is cut into for the running sums.
RANGES = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources in code-point order, null last.

    A target stops at ``most`` times its source's size; what it can't take goes to the others by
    weight. In the order of size / weight the stopped sources come first, so running sums of whole
    numbers tell which they are, and every target is one rounded quotient. The windows hold one row
    for each source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    numbered = total.withColumn("n", (F.row_number().over(order) - 1) % len(weights))
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("n") + 1).cast("bigint"))
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    ahead = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cut = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stands = (
        weighed.withColumn("filled", most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(ahead))
        .withColumn("due", share * F.sum("source_size").over(cut))
        .withColumn("stops", most * F.col("source_size") * F.col("left_weight") <= (F.col("due") - F.col("filled")) * F.col("weight"))
    )
    open_ = ~F.col("stops")
    rest = stands.withColumn("spent", most * F.coalesce(F.sum(F.when(F.col("stops"), F.col("source_size"))).over(cut), F.lit(0)))
    rest = rest.withColumn("open_weight", F.sum(F.when(open_, F.col("weight"))).over(cut))
    target = F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise(
        (F.col("due") - F.col("spent")) * F.col("weight") / F.col("open_weight")
    )
    return rest.select("source", "source_size", target.alias("target"))


def sized(docs: DataFrame, size: Column | None = None, propensity: Column | None = None) -> DataFrame:
    """(id, source, size, u, tie, odds) of every document, staged: all later steps work on this narrow table."""
    size = word_count(F.col("text")) if size is None else size
    return stage(docs.select(F.col("doc_id").alias("id"), "source", size.cast("bigint").alias("size"), *_draw(propensity)), "sized")


def mixing_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, ranges: int = RANGES) -> DataFrame:
    """One row for each source: source, source_size, target, whole, f and the last key (x, id, tie) that is sampled."""
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    plan = source_targets(rows, weights, share, most).withColumn("rate", rate)
    plan = plan.withColumn("whole", F.floor("rate").cast("bigint")).withColumn("f", F.col("rate") - F.col("whole")).drop("rate")
    plan = stage(plan.withColumn("due", F.col("target") - F.col("whole") * F.col("source_size")), "targets")

    # x / (1 + x) is in (0, 1) and in the order of x.
    odds = F.col("key.x") / (1 + F.col("key.x"))
    ranked = _with_plan(rows, plan).where("f > 0").withColumn("key", _key()).withColumn("range", F.floor(ranges * odds).cast("bigint"))
    in_order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranked.groupBy("source", "range", "due").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(in_order), F.lit(0))).where("before <= due")
    last = sums.groupBy(F.col("source").alias("s")).agg(F.max_by(F.struct("range", "before"), "range").alias("last"))

    edge = ranked.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("last.range"))).drop("s")
    inside = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("last.before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    taken = edge.withColumn("fits", ahead + F.col("size") / 2 <= F.col("due")).where("fits")
    cuts = taken.groupBy(F.col("source").alias("s")).agg(F.max("key").alias("cut"))
    plan = plan.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # A source whose edge range gives nothing is cut before that range.
    return stage(plan.select("source", "source_size", "target", "whole", "f", F.col("last.range").alias("edge"), "cut"), "plan")


def with_copies(rows: DataFrame, plan: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Add source_size, target and copies to rows that have id, source, u, tie and odds. Nothing is shuffled
    while the plan, one row for each source, is small enough for Spark to broadcast."""
    key = _key()
    range_ = F.floor(ranges * (key["x"] / (1 + key["x"]))).cast("bigint")
    extra = F.coalesce((F.col("f") > 0) & ((range_ < F.col("edge")) | (key <= F.col("cut"))), F.lit(False))
    joined = _with_plan(rows, plan)
    return joined.withColumn("copies", F.col("whole") + extra.cast("bigint")).drop("whole", "f", "edge", "cut")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns it had.

    The texts are read twice, and never shuffled: once for sizes, once with each source's cut at hand.
    """
    plan = mixing_plan(sized(docs), weights, share, most)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("id"), "source", *_draw(None))
    taken = with_copies(rows, plan).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")


def _draw(propensity: Column | None) -> list[Column]:
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    odds = F.lit(1.0) if propensity is None else F.coalesce(propensity.cast("double"), F.lit(1.0))
    return [u.alias("u"), F.xxhash64("text").alias("tie"), odds.alias("odds")]


def _key() -> Column:
    x = (F.col("u") / (1 - F.col("u"))) * F.try_divide(1 - F.col("f"), F.col("f")) / F.col("odds")
    return F.struct(x.alias("x"), F.col("id").alias("id"), F.col("tie").alias("tie"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with the figures of their source; there is one row for each source, null included."""
    plan = plan.withColumnRenamed("source", "s")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
