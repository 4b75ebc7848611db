"""Grouping sets, sketches, membership of many cohorts, ranks, sequences: against brute force and at a skew."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prevalo import operators as op
from prevalo.sources import stage
from tests.conftest import rows
from tests.test_differential import plan_of

DEMO = "PSID long, ICD_CODE string, BJAHR int, AGE string, SEX string"
DIMS = ["ICD_CODE", "BJAHR", "AGE", "SEX"]
HOT = 1


def order(r):
    return [(v is not None, v) for v in r]


def person(draw):
    return HOT if draw.random() < 1 / 3 else draw.randint(2, 40)


@pytest.fixture(scope="module")
def demo():
    draw = random.Random(4)
    some = [(person(draw), draw.choice(["A", "B", None]), draw.choice([2000, 2001, None]), draw.choice("xyz"), draw.choice(["f", "m", None])) for _ in range(500)]
    return [*some, *some[:50], (None, "A", 2000, "x", "f")]


# --- grouping sets --------------------------------------------------------------------------


@pytest.mark.parametrize("sets", [None, [["ICD_CODE", "SEX"], ["BJAHR"], [], ["SEX", "ICD_CODE"]]])
def test_persons_in_sets(spark, demo, sets):
    kept = {frozenset(s) for s in sets} if sets is not None else {frozenset(s) for n in range(5) for s in itertools.combinations(DIMS, n)}
    want = Counter()
    for s in kept:
        level = sum(8 >> i for i, d in enumerate(DIMS) if d not in s)
        want.update({(*[v if d in s else None for d, v in zip(DIMS, r[1:], strict=True)], level, r[0]) for r in demo if r[0] is not None})
    counts = Counter(w[:-1] for w in want)
    found = op.persons_in_sets(spark.createDataFrame(demo, DEMO), DIMS, sets)
    text = plan_of(found)
    assert text.count("Exchange") == 2 and "Expand" not in text and text.count("Scan ExistingRDD") == 1
    assert rows(found) == sorted(((*k, n) for k, n in counts.items()), key=order)
    with pytest.raises(ValueError, match="AGES"):
        op.persons_in_sets(spark.createDataFrame(demo, DEMO), DIMS, [["AGES"]])


def test_a_hot_person_is_a_bounded_set(spark):
    many = spark.range(300_000).selectExpr("IF(id % 3 = 0, 1L, id % 1000) AS PSID", "CONCAT('c', id % 5) AS ICD_CODE", "CAST(2000 + id % 3 AS INT) AS BJAHR")
    found = {(r.ICD_CODE, r.BJAHR): r.N_PERSONS for r in op.persons_in_sets(many, ["ICD_CODE", "BJAHR"]).collect()}
    exact = many.agg(F.count_distinct("PSID")).first()[0]
    assert found[None, None] == exact and len(found) == 6 * 4


# --- sketches -------------------------------------------------------------------------------


def test_sketches_add_up_within_their_error(spark, tmp_path):
    """Persons overlap between years: the union of stored sketches is the sketch of all rows, near the exact count."""
    visits = spark.range(400_000).selectExpr(
        "IF(id % 3 = 0, 7L, xxhash64(id DIV 4) % 60000) AS PSID", "CONCAT('c', id % 3) AS ICD_CODE", "CAST(2000 + id % 4 AS INT) AS BJAHR"
    )
    op.person_sketches(visits, ["ICD_CODE", "BJAHR"]).write.parquet(str(tmp_path / "sketches"))
    kept = spark.read.parquet(str(tmp_path / "sketches"))
    assert kept.select(F.max(F.octet_length("SKETCH"))).first()[0] < 2 << op.margins.LG_K
    united = dict(rows(op.estimated_persons(op.unite_sketches(kept, ["ICD_CODE"]))))
    direct = dict(rows(op.estimated_persons(op.person_sketches(visits, ["ICD_CODE"]))))
    exact = dict(rows(visits.groupBy("ICD_CODE").agg(F.count_distinct("PSID"))))
    assert max(exact.values()) > 20_000
    for code, n in exact.items():
        assert abs(united[code] - n) <= op.sketch_error() * n
        assert abs(united[code] - direct[code]) <= op.sketch_error(deviations=1) * n
    whole = op.estimated_persons(op.unite_sketches(kept, [])).first()[0]
    assert abs(whole - visits.agg(F.count_distinct("PSID")).first()[0]) <= op.sketch_error() * whole


# --- membership -----------------------------------------------------------------------------


def test_membership(claims):
    draw = random.Random(8)
    codes = ["A1", "A2", "B1", "C", "D9", "Z"]
    amb = [(person(draw), 1, 2000, draw.choice(codes), draw.choice("GV")) for _ in range(300)]
    c = claims(amb=amb, kh=[(50, 1, 2000, "A1", None), (None, 1, 2000, "A1", None)])
    cohorts = {"ONE": "A", "TWO": ("B", "C"), "THREE": "D9", "ALL_OF_A1": "A1"}
    starts = [("A",), ("B", "C"), ("D9",), ("A1",)]
    held = {}
    for p, _, _, code, sure in [*((p, v, y, x, s) for p, v, y, x, s in amb if s == "G"), (50, 1, 2000, "A1", "G")]:
        held.setdefault(p, set()).update(i for i, s in enumerate(starts) if code.startswith(s))
    want = Counter(sum(1 << i for i in s) for s in held.values())
    members = op.membership(c.diagnoses, cohorts)
    assert plan_of(members).count("Exchange") == 1
    found = op.membership_counts(members, cohorts)
    assert rows(found, "MASK", "N_PERSONS") == [(m, want[m]) for m in range(16)]
    assert rows(found.filter("MASK = 5"), "ONE", "TWO", "THREE", "ALL_OF_A1") == [(True, False, True, False)]
    both = op.members_of(members, cohorts, inside=["ONE"], outside=["TWO", "THREE"])
    assert rows(both) == sorted((p,) for p, s in held.items() if 0 in s and not s & {1, 2})
    for refused in ({}, {str(i): "A" for i in range(17)}):
        with pytest.raises(ValueError, match="cohorts"):
            op.membership(c.diagnoses, refused)


# --- ranks ----------------------------------------------------------------------------------


@pytest.mark.parametrize(("count", "n"), [(0, 4), (3, 10), (10, 10), (103, 10), (1000, 7), (1000, 1)])
def test_tiles_and_ranks(spark, count, n):
    draw = random.Random(count)
    values = [(draw.choice([None, 1, 1, 1, 2, 50]), i) for i in range(count)]
    df = spark.createDataFrame(values, "V int, ID long")
    placed = sorted(values, key=order)
    size, larger = divmod(count, n)
    bounds = [t + 1 for t in range(n) for _ in range(size + (t < larger))]
    assert rows(op.tiles(df, ["V", "ID"], n, ranges=5)) == sorted(((*v, t) for v, t in zip(placed, bounds, strict=True)), key=order)
    found, total = op.ranked(df, ["V", "ID"], ranges=5)
    assert total == count and rows(found) == sorted(((*v, i + 1) for i, v in enumerate(placed)), key=order)
    with pytest.raises(ValueError, match="tile"):
        op.tiles(df, ["V"], 0)


def test_no_task_ranks_all_rows(spark):
    """A value that a third of all rows share is divided by the unique column."""
    df = spark.range(30_000).selectExpr("IF(id % 3 = 0, 5L, id) AS V", "id AS ID")
    found, _ = op.ranked(df, ["V", "ID"], ranges=10)
    assert "hashpartitioning(__RANGE" in plan_of(found) and "SinglePartition" not in plan_of(found)
    ranges = op.ranks.stage(df.repartitionByRange(10, "V", "ID").withColumn("R", F.spark_partition_id()), "t").groupBy("R").count()
    assert ranges.agg(F.max("count")).first()[0] < 6000


def test_quantiles(spark):
    df = spark.createDataFrame([(v, i) for i, v in enumerate([5, 1, None, 2, 2, 9])], "V int, ID long")
    assert rows(op.quantiles(df, "V", ["ID"], [0, 0.2, 0.21, 0.5, 0.6, 0.61, 1.0])) == [
        (0.0, 1), (0.2, 1), (0.21, 2), (0.5, 2), (0.6, 2), (0.61, 5), (1.0, 9),
    ]
    assert op.quantiles(df.filter("V > 99"), "V", ["ID"], [0.5]).count() == 0
    with pytest.raises(ValueError, match="shares"):
        op.quantiles(df, "V", ["ID"], [1.1])


# --- sequences ------------------------------------------------------------------------------


def test_sequences_and_transitions(claims):
    c = claims(amb=[(1, 1, 2003, "A", "G"), (1, 1, 2001, "A", "G"), (1, 1, 2002, "C", "G"), (1, 1, 2001, "B", "V"), (1, 1, 2004, "B", "G"), (2, 1, 2001, "B", "G"), (2, 1, 2001, "A", "G")])
    found = op.code_sequences(c.diagnoses)
    assert [(r.PSID, r.N_CODES, [(x.BJAHR, x.ICD_CODE) for x in r.SEQUENCE]) for r in found.orderBy("PSID").collect()] == [
        (1, 3, [(2001, "A"), (2002, "C"), (2004, "B")]), (2, 2, [(2001, "A"), (2001, "B")]),
    ]
    assert rows(op.transitions(found, 2)) == [("A", "C", 1), ("C", "B", 1)]
    assert ("A", "B", 1) in rows(op.transitions(found, 3))


@pytest.mark.parametrize("within", [1, 3])
def test_followed_by(claims, within):
    draw = random.Random(within)
    amb = [(person(draw), 1, draw.randint(2000, 2012), draw.choice(["A1", "A2", "B", "C"]), draw.choice("GV")) for _ in range(250)]
    sure = {(p, y, code) for p, _, y, code, s in amb if s == "G"}
    pairs = sorted((p, a, b) for p, a, x in sure for q, b, y in sure if p == q and x[0] == "A" and y == "B" and 0 < b - a <= within)
    want = {p: (p, a, b) for p, a, b in reversed(pairs)}
    assert rows(op.followed_by(claims(amb=amb).diagnoses, "A", "B", within, exact=False)) == sorted(want.values())
    with pytest.raises(ValueError, match="later"):
        op.followed_by(claims(amb=amb).diagnoses, "A", "B", 0)


def test_a_person_with_a_million_rows_is_reduced_before_it_is_collected(spark, claims):
    amb = spark.range(1_000_000).selectExpr("1L AS PSID", "1L AS VSID", "CAST(2000 + id % 10 AS INT) AS BJAHR", "CONCAT('A', id % 20) AS ICDAMB_CODE", "'G' AS DIAGSICH")
    diagnoses = op.unified_diagnoses(stage(amb, "many"))
    (one,) = op.code_sequences(diagnoses).collect()
    assert one.N_CODES == 20
    found = op.followed_by(diagnoses, "A0", "A3", 5)
    # Partial sets: what a task sends for the person is its years, not its rows.
    text = plan_of(found)
    assert text.count("Exchange") == 1 and text.count("ObjectHashAggregate") == 2
    assert rows(found) == [(1, 2000, 2003)]
