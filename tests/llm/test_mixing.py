import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from prevalo.llm import mixing
from prevalo.llm.queries import OP6_SQL, op6_mixing

SOURCES = ["a", "b", "ä", "z", None]


def rows_of(n, heavy="b"):
    for i in range(n):
        yield i, " ".join(["w"] * (i * 7 % 23)) if i % 19 else None, "en", heavy if i % 3 == 0 else SOURCES[i % 5]


def plain_targets(sizes):
    """Water filling with fractions: fix the sources above their most, share again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    due, target, open_ = Fraction(3, 2) * sum(sizes.values()), {}, set(order)
    while open_:
        share = {s: due * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not above:
            return {k: float(v) for k, v in (target | share).items()}
        for s in above:
            target[s] = Fraction(2 * sizes[s])
            due -= target[s]
        open_ -= above
    return {k: float(v) for k, v in target.items()}


def plain_mix(rows):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    by = defaultdict(list)
    for i, _, _, s in rows:
        by[s].append(i)
    total = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    target, out = plain_targets(total), {}
    for s, ids in by.items():
        rate = target[s] / total[s] if total[s] else 0.0
        whole, f = int(rate), rate - int(rate)
        u = {i: (int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in ids}
        due, words = target[s] - whole * total[s], 0
        ranked = sorted(ids, key=lambda i: (u[i] / (1 - u[i]) * ((1 - f) / f), i)) if f else ids
        for i in ranked:
            extra = f > 0 and words + size[i] / 2 <= due
            words += size[i]
            out[i] = (size[i], total[s], target[s], (whole + extra) * size[i])
    return out


@pytest.mark.parametrize("ranges", [1, 16, 4096])
def test_equals_the_plain_mix_for_any_ranges(documents, ranges):
    rows = list(rows_of(400))
    sized = mixing.sized(documents(rows))
    got = mixing.with_copies(sized, mixing.mixing_plan(sized, ranges=ranges), ranges).collect()
    want = plain_mix(rows)
    assert {r.id: (r["size"], r.source_size, r.target, r.copies * r["size"]) for r in got} == want
    for s in SOURCES:
        mine = [want[i] for i, _, _, x in rows if x == s]
        assert abs(sum(t for *_, t in mine) - mine[0][2]) <= 11.5
    assert all(t <= 2 * n for n, _, _, t in want.values())


def test_mixed_rows_keep_their_columns(documents):
    rows = [*rows_of(200), (7, "twice " * 9, None, "a"), (7, "twice " * 9, None, "a"), (None, "no id " * 5, None, "a"), (900, "x " * 50_000, None, "z")]
    df = documents(rows).withColumns({"size": F.lit("clash"), "u": F.lit(1), "copies": F.lit(None).cast("int"), "f": F.lit(2)})
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    first, again = Counter(map(tuple, mixed.collect())), Counter(map(tuple, mixing.mix(df).collect()))
    assert first == again and set(first) <= set(map(tuple, df.collect())) and max(first.values()) <= 4


def test_propensities_change_the_odds(documents):
    rows = [(i, "ten words " * 5, None, "ab"[i % 2] if i < 1000 else "c") for i in range(1100)]
    df = documents(rows)
    sized = mixing.sized(df, propensity=F.when(F.col("doc_id") % 4 == 0, 8.0))
    taken = mixing.with_copies(sized, mixing.mixing_plan(sized))
    part = {bool(r.favoured): r.rate for r in taken.where("source = 'b' or source = 'a'").groupBy((F.col("id") % 4 == 0).alias("favoured")).agg(F.avg("copies").alias("rate")).collect()}
    assert part[True] > part[False]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "", None, "a"), (2, " ", None, "b")]])
def test_nothing_to_mix(documents, rows):
    sized = mixing.sized(documents(rows))
    got = mixing.with_copies(sized, mixing.mixing_plan(sized)).collect()
    assert len(got) == len(rows) and all(r.target == 0 and r["size"] == 0 for r in got)
    assert mixing.mix(documents(rows)).count() >= 0


def test_check_sql(spark, text_dir):
    engine = duckdb.connect()
    engine.execute(f"create view documents as select * from '{text_dir}/documents.parquet'")
    want = sorted(tuple(r) for r in engine.execute(f"select doc_id, size, source_size, target, taken from ({OP6_SQL})").fetchall())
    assert sorted(tuple(r) for r in op6_mixing(spark, text_dir).select("doc_id", "size", "source_size", "target", "taken").collect()) == want


def test_no_python_in_the_plan(documents):
    sized = mixing.sized(documents(list(rows_of(20))))
    plan = mixing.with_copies(sized, mixing.mixing_plan(sized))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
