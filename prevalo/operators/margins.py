"""Distinct persons over many groupings at once: all margins, and sketches that can be added up."""

import itertools
import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base-2 logarithm of the registers of a person sketch.
LG_K = 12


def persons_in_sets(demo: DataFrame, dims: Sequence[str], sets: Iterable[Sequence[str]] | None = None, name: str = "N_PERSONS") -> DataFrame:
    """Distinct persons for every combination of ``dims`` in each grouping set: dims (NULL where added up), LEVEL and the count.

    ``sets`` are lists of the dims that stay, by default all subsets (a cube). LEVEL has a bit for each dim that is added up, the last
    dim's being the lowest, so a NULL of the data differs from one that means all.

    A person's combinations are collected first, a set bounded by the categories whatever the number of rows, and
    each set of dims is formed, and made distinct, within the person. So persons are shuffled once, counted once in each cell, and
    what moves after that are partial counts of cells. An expansion of rows before a distinct count would shuffle a row for
    each person, cell and grouping set.
    """
    dims = list(dims)
    kept = [tuple(s) for s in sets] if sets is not None else [s for n in range(len(dims) + 1) for s in itertools.combinations(dims, n)]
    unknown = {d for s in kept for d in s} - set(dims)
    if unknown:
        raise ValueError(f"not among the dims: {sorted(unknown)}")
    types = dict(demo.select(*dims).dtypes)

    def cells(x):
        for s in dict.fromkeys(frozenset(s) for s in kept):
            level = sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in s)
            columns = [(x[f"d{i}"] if d in s else F.lit(None).cast(types[d])).alias(f"d{i}") for i, d in enumerate(dims)]
            yield F.struct(F.lit(level).cast("long").alias("level"), *columns)

    own = F.collect_set(F.struct(*[F.col(d).alias(f"d{i}") for i, d in enumerate(dims)]))
    persons = demo.filter("PSID IS NOT NULL").groupBy("PSID").agg(own.alias("OWN"))
    # Within a person: a cell for each combination and grouping set, once.
    spread = F.array_distinct(F.flatten(F.transform("OWN", lambda x: F.array(*cells(x)))))
    counted = persons.select(F.explode(spread).alias("X")).groupBy("X").agg(F.count("*").alias(name))
    return counted.select(*[F.col(f"X.d{i}").alias(d) for i, d in enumerate(dims)], F.col("X.level").alias("LEVEL"), name)


def person_sketches(demo: DataFrame, by: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """A HyperLogLog sketch of the persons of each group, as SKETCH: some kilobytes each, whatever the group's size.

    Store them as a table; sketches of other groups, files and years can be united with them later.
    """
    return demo.groupBy(*by).agg(F.hll_sketch_agg("PSID", F.lit(lg_k)).alias("SKETCH"))


def unite_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups: persons that are in several are counted once."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("SKETCH").alias("SKETCH"))


def estimated_persons(sketches: DataFrame, name: str = "N_PERSONS_ABOUT") -> DataFrame:
    """The number of distinct persons of each sketch, in its place."""
    kept = [c for c in sketches.columns if c != "SKETCH"]
    return sketches.select(*kept, F.hll_sketch_estimate("SKETCH").alias(name))


def sketch_error(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """Relative error of an estimate at a number of standard deviations."""
    return deviations * 1.04 / math.sqrt(1 << lg_k)
