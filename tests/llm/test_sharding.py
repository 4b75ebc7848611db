import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from prevalo.llm import sharding
from prevalo.llm.queries import op8_sharding


def spread(rows):
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        load[r.placed["shard"]] += r.placed["size"]
        slots[r.placed["shard"]].append(r.placed["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def plain_place(units, shards, epsilon):
    """The walk, one virtual node after the other."""
    points = sorted((p, s) for p, s in zip(*sharding.ring(shards), strict=True))
    bound, load, out = (1 + epsilon) * sum(u[2] for u in units) / shards, Counter(), {}
    for u in sorted(units, key=lambda u: (-u[2].bit_length(), u[0], u[1])):
        at = u[0] * ((1 << 64) // sharding.CELLS)
        clockwise = [s for p, s in points if p >= at] + [s for p, s in points if p < at]
        fits = [s for s in clockwise if load[s] + u[2] <= bound]
        out[u] = fits[0] if fits else min(range(shards), key=lambda s: (load[s], s))
        load[out[u]] += u[2]
    return [out[u] for u in units]


def test_walk_equals_the_plain_walk():
    units = [((i * 7919) % sharding.CELLS, 0, 1 + i * i % 97, 1) for i in range(800)]
    assert sharding.place(units, 7, epsilon=0.01) == plain_place(units, 7, 0.01)


def test_few_units_move_when_a_shard_joins():
    units = [(i * 37 % sharding.CELLS, 0, 10, 1) for i in range(800)]
    before, after = (sharding.place(units, n, epsilon=0.05) for n in (10, 11))
    assert sum(a != b for a, b in zip(before, after, strict=True)) < 0.45 * len(units)


def test_loads_are_near_equal_and_equal_texts_together(spark, documents):
    rows = [(i, f"text {i % 1500} " * (1 + i % 7)) for i in range(3000)]
    got = sharding.shard(documents(rows), shards=8).collect()
    load = spread(got)
    mean = sum(load.values()) / 8
    assert max(load.values()) - min(load.values()) < 0.02 * mean
    where = defaultdict(set)
    for r in got:
        where[r.doc["text"]].add(r.placed["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_a_text_of_a_third_of_all_rows_is_split(documents):
    rows = [(i, "always the same" if i % 3 == 0 else f"other {i}") for i in range(3000)]
    load = spread(sharding.shard(documents(rows), shards=10).collect())
    assert max(load.values()) - min(load.values()) < 0.06 * sum(load.values()) / 10


def test_nulls_repeats_clashes_and_reruns(documents):
    rows = [(1, None), (1, None), (None, "x"), (None, None), (2, ""), (3, "é" * 10_000), (3, "é" * 10_000)]
    df = documents(rows).withColumns({"shard": F.lit("clash"), "cell": F.lit(1), "piece": F.lit(2), "size": F.lit(3)})
    got = sharding.shard(df, shards=3).collect()
    spread(got)
    assert sorted(r.placed["size"] for r in got) == [16, 16, 16, 16, 17, 20016, 20016]
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard(df, shards=3).collect()))
    assert got[0].doc.asDict().keys() == set(df.columns)


@pytest.mark.parametrize("rows", [[], [(5, "alone")]])
def test_fewer_rows_than_shards(documents, rows):
    assert sharding.shard(documents(rows)).count() == len(rows)


def test_whole_table(spark, text_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{text_dir}/documents.parquet").collect()}
    got = op8_sharding(spark, text_dir).collect()
    assert {r.doc_id: (r["size"], r.text_crc32, r.law, r.grown_shard) for r in got} == {
        i: (len(t.encode()) + 16, zlib.crc32(t.encode()), "bytes", None) for i, t in rows.items()
    }
