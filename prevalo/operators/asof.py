"""The latest state at or before an event."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prevalo.operators.cohort import CONTRACT, PERSON, _reduce
from prevalo.operators.diagnoses import is_confirmed


def as_of(
    events: DataFrame,
    states: DataFrame,
    on: Sequence[str],
    event_time: str,
    state_time: str,
    values: Sequence[str],
    *,
    allow_equal: bool = True,
    bin_width: int | None = None,
) -> DataFrame:
    """Every event with the values of the latest state of its key, and that state's time.

    Events and states become one tagged table, which one window runs over: one shuffle, and no pair of an event
    with more than one state is ever built. ``allow_equal`` lets a state count for an event of the same time.
    Events without a state keep NULLs; so do events with a NULL key or time. Of several states of one key and time the
    least one counts (by its values in order, NULL first).

    A key is a window of its own, so give events reduced, with a count. Where a key still has too many rows for a
    task, ``bin_width`` divides it by time: each bin looks back within itself, and the last state of earlier bins,
    one row for each, is carried into it.
    """
    taken = set(values) | {state_time}
    if taken & set(events.columns):
        raise ValueError(f"columns on both sides: {sorted(taken & set(events.columns))}")
    known = states.filter(F.col(state_time).isNotNull())
    for k in on:
        known = known.filter(F.col(k).isNotNull())
    known = known.groupBy(*on, state_time).agg(F.min(F.struct(*values)).alias("__V"))
    state = F.struct(F.col(state_time).alias("t"), F.col("__V").alias("v"))
    known = known.select(*on, F.col(state_time).alias("__T"), F.lit(0 if allow_equal else 2).alias("__TAG"), state.alias("__S"))
    carried = [c for c in events.columns if c not in on]
    mine = events.select(*on, F.col(event_time).alias("__T"), F.lit(1).alias("__TAG"), F.struct(*carried).alias("__E"))
    both = mine.unionByName(known, allowMissingColumns=True)
    behind = [Window.unboundedPreceding, Window.currentRow]
    if bin_width is None:
        order = Window.partitionBy(*on).orderBy("__T", "__TAG").rowsBetween(*behind)
        found = both.withColumn("__LAST", F.last("__S", ignorenulls=True).over(order))
    else:
        both = both.withColumn("__BIN", F.floor(F.col("__T") / bin_width))
        order = Window.partitionBy(*on, "__BIN").orderBy("__T", "__TAG").rowsBetween(*behind)
        near = both.withColumn("__NEAR", F.last("__S", ignorenulls=True).over(order))
        # One row for each bin: its last state, then that of the bins before it. Bins that hold events only are there too.
        last = both.groupBy(*on, "__BIN").agg(F.max_by("__S", F.when(F.col("__S").isNotNull(), F.col("__T"))).alias("__OWN"))
        earlier = Window.partitionBy(*on).orderBy("__BIN").rowsBetween(Window.unboundedPreceding, -1)
        last = last.withColumn("__FAR", F.last("__OWN", ignorenulls=True).over(earlier)).drop("__OWN").filter("__FAR IS NOT NULL")
        found = near.join(last, [*on, "__BIN"], "left").withColumn("__LAST", F.coalesce("__NEAR", "__FAR"))
    rows = found.filter(F.col("__TAG") == 1).select(*on, "__E.*", F.col("__LAST.t").alias(state_time), "__LAST.v.*")
    return rows.select(*events.columns, state_time, *values)


def master_as_of(diagnoses: DataFrame, vers: DataFrame, *, confirmed_only: bool = True, allow_equal: bool = True, bin_width: int | None = None) -> DataFrame:
    """Persons' diagnosis years with birth year and postcode of the latest master row up to that year (``vers`` needs BJAHR).

    Unlike a minimum over all rows, which mixes what was true at different times, this takes what was known then.
    """
    events = diagnoses.filter(is_confirmed()) if confirmed_only else diagnoses
    states = vers.select("PSID", F.col("BJAHR").alias("MASTER_YEAR"), "GEBJAHR", "PLZ")
    return as_of(_reduce(events, PERSON, "rows"), states, PERSON, "BJAHR", "MASTER_YEAR", ["GEBJAHR", "PLZ"], allow_equal=allow_equal, bin_width=bin_width)


def sex_as_of(diagnoses: DataFrame, versq: DataFrame, *, confirmed_only: bool = True, known_only: bool = True, bin_width: int | None = None) -> DataFrame:
    """Contracts' diagnosis years with the sex of the latest quarter up to that year's end; ``known_only`` looks past unknown entries."""
    events = diagnoses.filter(is_confirmed()) if confirmed_only else diagnoses
    reduced = _reduce(events, CONTRACT, "rows").withColumn("UNTIL", F.col("BJAHR") * 10 + 4)
    states = versq.filter(F.col("GESCHLECHT").isin(1, 2)) if known_only else versq
    return as_of(reduced, states, CONTRACT, "UNTIL", "VERSQ", ["GESCHLECHT"], bin_width=bin_width).drop("UNTIL")
