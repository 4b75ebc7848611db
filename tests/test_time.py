"""Spells, interval and as-of joins, incidence: against brute force, with a third of all rows on one person."""

import random

import pytest
from pyspark.sql import functions as F

from prevalo import operators as op
from tests.conftest import VERSQ, rows
from tests.test_differential import plan_of as plan
from tests.test_plans import broadcasting

LEFT, RIGHT = "K long, LA int, LZ int, ID int", "K long, RA int, RZ int, R int"
HOT = 1


def keys(draw):
    return HOT if draw.random() < 1 / 3 else draw.randint(2, 25)


def quarter(number):
    return number // 4 * 10 + number % 4 + 1


@pytest.fixture(params=["10MB", "-1"], ids=["broadcast", "shuffle"])
def joins(request, spark):
    with broadcasting(spark, request.param):
        yield spark


# --- interval joins -------------------------------------------------------------------------


@pytest.mark.parametrize(("width", "hot_rows"), [(1, 1 << 20), (7, 40), (1000, 10)])
def test_interval_join_against_all_pairs(joins, width, hot_rows):
    draw = random.Random(width)

    def interval():
        a = draw.randint(-30, 60)
        return a, a + draw.choice([0, 0, 1, 5, 40])

    left = [(keys(draw), *interval(), i) for i in range(400)] + [(None, 1, 9, 900), (2, None, 9, 901), (2, 9, 1, 902)]
    right = [(keys(draw), *interval(), i) for i in range(120)] + [(None, 1, 9, 900), (2, 5, None, 901), (3, 9, 1, 902)]
    met = op.interval_join(
        joins.createDataFrame(left, LEFT), joins.createDataFrame(right, RIGHT), ["K"], ("LA", "LZ"), ("RA", "RZ"), width, hot_rows
    )
    valid = [r for r in right if None not in r and r[1] <= r[2]]
    want = [(k, a, z, i, b, y, j) for k, a, z, i in left if None not in (k, a, z) and a <= z for h, b, y, j in valid if h == k and a <= y and b <= z]
    assert rows(met) == sorted(want) and len(want) > 500
    text = plan(met)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_interval_join_divides_hot_keys(spark):
    """With one person in half of all rows several tasks share its pairs."""
    left = spark.range(4000).selectExpr("IF(id % 2 = 0, 1, id) AS K", "CAST(id % 50 AS INT) AS LA", "CAST(id % 50 + 1 AS INT) AS LZ", "CAST(id AS INT) AS ID")
    right = spark.createDataFrame([(1, 0, 100, 0), (3, 0, 100, 1)], RIGHT)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        met = op.interval_join(left, right, ["K"], ("LA", "LZ"), ("RA", "RZ"), 1000, hot_rows=100)
        tasks = met.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in tasks) == 2002 and len(tasks) > 2  # not in the task of one key
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with pytest.raises(ValueError, match="both sides"):
        op.interval_join(left, left.withColumnRenamed("ID", "X"), ["K"], ("LA", "LZ"), ("LA", "LZ"), 5)


# --- spells ---------------------------------------------------------------------------------


@pytest.mark.parametrize("gap", [0, 1, 3])
def test_spells(spark, gap):
    draw = random.Random(gap)
    versq = [(keys(draw), 1, quarter(8000 + draw.randint(0, 40)), 1) for _ in range(300)]
    versq += [(5, 1, 20005, 1), (5, 1, None, 1), (30, 1, 20000, 2), (31, 1, 20004, 2), (31, 1, 20011, 2)]
    want = []
    for person in {v[0] for v in versq}:
        numbers = sorted({v[2] // 10 * 4 + v[2] % 10 - 1 for v in versq if v[0] == person and v[2] and 1 <= v[2] % 10 <= 4})
        spells = []
        for n in numbers:
            if spells and n - spells[-1][-1] <= gap + 1:
                spells[-1].append(n)
            else:
                spells.append([n])
        want += [(person, i + 1, quarter(s[0]), quarter(s[-1]), len(s)) for i, s in enumerate(spells)]
    found = op.insured_spells(spark.createDataFrame(versq, VERSQ), max_gap=gap)
    assert plan(found).count("Exchange hashpartitioning") == 2  # distinct quarters, then the spells' window and counts
    assert rows(found) == sorted(want) and (31, 1, 20004, 20011, 2) in want


def test_a_persons_repeated_quarters_leave_each_task_once(spark):
    versq = spark.range(100_000).selectExpr("IF(id % 3 = 0, 1L, id) AS PSID", "1L AS VSID", "CAST(20001 + id % 4 AS INT) AS VERSQ", "1 AS GESCHLECHT")
    text = plan(op.insured_spells(versq))
    assert text.index("Window") < text.index("HashAggregate", text.index("Window"))
    assert op.insured_spells(versq).filter("PSID = 1").collect()[0].N_QUARTERS == 4


def test_diagnosis_spells(claims):
    c = claims(
        amb=[(1, 1, 2000, "A", "G"), (1, 1, 2000, "A", "G"), (1, 1, 2000, "A", "V"), (1, 1, 2003, "A", "G"), (2, 1, 2000, "B", "G")],
        kh=[(1, 1, 2001, "C", None)],
        versq=[(1, 1, q, 1) for q in (20001, 20003, 20004, 20011, 20014)],
    )
    assert rows(op.diagnosis_spells(c.diagnoses, c.versq)) == [
        (1, "A", 2000, 2, 1, 20001, 20001, 1), (1, "A", 2000, 2, 2, 20003, 20011, 2),
        (1, "C", 2001, 1, 2, 20003, 20011, 1), (1, "C", 2001, 1, 3, 20014, 20014, 1),
    ]
    assert rows(op.person_quarters(c.versq)) == [(2000, 1, 3), (2001, 1, 2)]


# --- as of ----------------------------------------------------------------------------------

EVENTS, STATES = "K long, T int, ID int", "K long, S int, V int, W string"


@pytest.mark.parametrize("allow_equal", [True, False])
@pytest.mark.parametrize("bin_width", [None, 1, 9])
def test_as_of_against_brute_force(spark, allow_equal, bin_width):
    draw = random.Random(2)
    events = [(keys(draw), draw.randint(-20, 80), i) for i in range(300)] + [(None, 5, 900), (2, None, 901), (99, 5, 902)]
    states = [(keys(draw), draw.randint(-20, 60), draw.choice([None, 1, 2]), draw.choice("xy")) for _ in range(150)]
    states += [(None, 1, 1, "x"), (2, None, 1, "x")]
    want = []
    for k, t, i in events:
        behind = [] if None in (k, t) else [s for s in states if s[0] == k and s[1] is not None and (s[1] < t or (allow_equal and s[1] == t))]
        last = max((s[1] for s in behind), default=None)
        least = min(((v is not None, v or 0, w, v) for _, s, v, w in behind if s == last), default=(0, 0, None, None))
        want.append((k, t, i, last, least[3], least[2]))
    found = op.as_of(
        spark.createDataFrame(events, EVENTS), spark.createDataFrame(states, STATES), ["K"], "T", "S", ["V", "W"], allow_equal=allow_equal, bin_width=bin_width
    )
    order = lambda r: [(v is not None, v) for v in r]
    assert rows(found) == sorted(want, key=order)
    text = plan(found)
    assert "Join" not in text if bin_width is None else "NestedLoop" not in text and "CartesianProduct" not in text


def test_as_of_is_one_shuffle_of_events(spark):
    events = spark.range(100).selectExpr("id % 7 AS K", "CAST(id AS INT) AS T", "id AS ID")
    states = spark.range(100).selectExpr("id % 7 AS K", "CAST(id AS INT) AS S", "id AS V")
    text = plan(op.as_of(events, states, ["K"], "T", "S", ["V"]))
    assert text.count("Exchange hashpartitioning") == 2  # states to one row for each time; then the window
    with pytest.raises(ValueError, match="both sides"):
        op.as_of(events, states.withColumnRenamed("V", "ID"), ["K"], "T", "S", ["ID"])


def test_master_and_sex_as_of(spark, claims):
    c = claims(amb=[(1, 1, 2001, "A", "G"), (1, 1, 2004, "A", "G")], versq=[(1, 1, 20003, 2), (1, 1, 20014, 0), (1, 1, 20051, 1)])
    vers = spark.createDataFrame([(1, 1, 2001, 1950, "01067"), (1, 1, 2003, 1951, "99999")], "PSID long, VSID long, BJAHR int, GEBJAHR int, PLZ string")
    assert rows(op.master_as_of(c.diagnoses, vers)) == [(1, "A", 2001, 1, 2001, 1950, "01067"), (1, "A", 2004, 1, 2003, 1951, "99999")]
    assert rows(op.master_as_of(c.diagnoses, vers, allow_equal=False))[0] == (1, "A", 2001, 1, None, None, None)
    assert [r[5:] for r in rows(op.sex_as_of(c.diagnoses, c.versq))] == [(20003, 2), (20003, 2)]
    assert [r[5:] for r in rows(op.sex_as_of(c.diagnoses, c.versq, known_only=False))] == [(20014, 0), (20014, 0)]


# --- incidence ------------------------------------------------------------------------------


@pytest.mark.parametrize("washout", [1, 2, 4])
def test_case_types_against_brute_force(spark, claims, washout):
    draw = random.Random(washout)
    amb = [(keys(draw), 1, draw.randint(2000, 2009), draw.choice(["A", "B"]), draw.choice("GV")) for _ in range(300)]
    versq = [(keys(draw), 1, draw.randint(1996, 2009) * 10 + draw.randint(1, 4), 1) for _ in range(700)]
    c = claims(amb=amb, versq=versq)
    years = {(p, code, y) for p, _, y, code, sure in amb if sure == "G"}
    insured = {(p, q // 10 * 4 + q % 10 - 1) for p, _, q, _ in versq}
    want, plain = [], []
    for p, code, y in years:
        last = max((z for q, d, z in years if (q, d) == (p, code) and z < y), default=None)
        since = None if last is None else y - last
        seen = all((p, n) in insured for n in range(4 * (y - washout), 4 * y))
        free = since is None or since > washout
        plain.append((p, code, y, since, "INCIDENT" if free else "PREVALENT"))
        want.append((p, code, y, since, "PREVALENT" if not free else "INCIDENT" if seen else "UNOBSERVED"))
    key = lambda r: [(v is not None, v) for v in r]
    cases = op.classify_cases(c.diagnoses, washout, c.versq)
    assert plan(cases).count("Exchange hashpartitioning") == 3  # two reductions and one shuffle for both windows
    assert rows(cases) == sorted(want, key=key)
    assert rows(op.classify_cases(c.diagnoses, washout)) == sorted(plain, key=key)
    rates = {(r.ICD_CODE, r.BJAHR): r for r in op.incidence(cases, c.versq).collect()}
    for code, y in {w[1:3] for w in want}:
        kinds = [w[4] for w in want if w[1:3] == (code, y)]
        r = rates[code, y]
        assert (r.N_INCIDENT, r.N_PREVALENT, r.N_UNOBSERVED) == tuple(map(kinds.count, ("INCIDENT", "PREVALENT", "UNOBSERVED")))
        assert r.PERSON_QUARTERS == len({i for i in insured if i[1] // 4 == y})
    with pytest.raises(ValueError, match="washout"):
        op.classify_cases(c.diagnoses, 0)


def test_codes_and_certainty_of_cases(claims):
    c = claims(amb=[(1, 1, 2000, "E849", "G"), (1, 1, 2001, "E8490", "V"), (2, 1, 2000, "Q780", "G")])
    assert rows(op.classify_cases(c.diagnoses, 1, codes="E84.9")) == [(1, "E849", 2000, None, "INCIDENT")]
    found = op.classify_cases(c.diagnoses, 1, codes="E84.9", exact=False, confirmed_only=False)
    assert [r[1] for r in rows(found)] == ["E849", "E8490"]


def test_episodes(claims):
    c = claims(amb=[(1, 1, y, "A", "G") for y in (2000, 2001, 2001, 2003, 2007)] + [(2, 1, 2005, "A", "G")])
    assert rows(op.episodes(c.diagnoses, 1)) == [(1, "A", 1, 2000, 2003, 3), (1, "A", 2, 2007, 2007, 1), (2, "A", 1, 2005, 2005, 1)]
    assert rows(op.episodes(c.diagnoses, 0))[1] == (1, "A", 2, 2003, 2003, 1)
    with pytest.raises(ValueError, match="gap"):
        op.episodes(c.diagnoses, -1)
