"""A third of all rows on one person, against brute force, broadcast and shuffled."""

import random
from collections import Counter, defaultdict

import pytest

from prevalo import operators as op
from prevalo.sources import stage
from tests.conftest import rows
from tests.test_plans import broadcasting

CODES = ["Q780", "S720", "S721", "I10", "R53", "R530", "M796", "UUU", "O300"]
HOT = 1


@pytest.fixture(scope="module")
def data():
    draw = random.Random(7)

    def person():
        return HOT if draw.random() < 1 / 3 else draw.randint(2, 40)

    def entry():
        return person(), draw.randint(1, 2), draw.randint(2015, 2018)

    amb = [(*entry(), draw.choice(CODES), draw.choice("GV")) for _ in range(1500)]
    kh = [(*entry(), draw.choice(CODES), draw.choice([None, *CODES])) for _ in range(700)]
    births, areas = [None, 1950, 1980, 2005], [None, "", "01067", "99"]
    vers = [(*entry()[:2], draw.choice(births), draw.choice(areas)) for _ in range(300)]
    versq = [(*entry()[:2], draw.randint(20151, 20159), draw.choice([None, 0, 1, 2, 2])) for _ in range(300)]
    return amb, kh, vers, versq


@pytest.fixture(params=["10MB", "-1"], ids=["broadcast", "shuffle"])
def case(request, spark, claims, data):
    with broadcasting(spark, request.param):
        yield claims(*data), data


def confirmed(data):
    amb, kh, _, _ = data
    yield from ((p, v, y, c, None) for p, v, y, c, sure in amb if sure == "G")
    yield from kh


def brute_cases(data):
    first = {}
    for p, v, y, c, secondary in confirmed(data):
        if "Q780" in (c, secondary):
            first[p, v, c] = min(y, first.get((p, v, c), y))
    return first


def brute_rest(data):
    cases = {p for p, _, _ in brute_cases(data)}
    first = {}
    for p, v, y, c, _ in confirmed(data):
        if p not in cases:
            first[p, v, c] = min(y, first.get((p, v, c), y))
    return first


def brute_sex(data):
    seen = defaultdict(set)
    for p, v, _, s in data[3]:
        seen[p, v] |= {s} & {1, 2}
    return {k: {1: "Female", 2: "Male"}[next(iter(s))] if len(s) == 1 else None for k, s in seen.items()}


def brute_birth(data):
    years = defaultdict(list)
    for p, v, g, _ in data[2]:
        years[p, v].append(g)
    return {k: min((g for g in ys if g is not None), default=None) for k, ys in years.items()}


def brute_band(year, birth, otherwise):
    if birth is None or year < birth:
        return otherwise
    age = year - birth
    return "0-18" if age <= 18 else "19-49" if age <= 49 else "50+"


def test_cohort_and_remaining(case):
    c, data = case
    cases = stage(op.cohort(c.diagnoses, "Q780", secondary=True, key=op.CONTRACT), "skew")
    assert rows(cases) == sorted((*k, y) for k, y in brute_cases(data).items())
    rest = op.remaining(c.diagnoses, cases)
    assert rows(rest) == sorted((*k, y) for k, y in brute_rest(data).items())


def test_age_sex_case_control(case):
    c, data = case
    sex, birth = brute_sex(data), brute_birth(data)
    seen = set()
    for (p, v, code), year in brute_cases(data).items():
        if (p, v) in birth and sex.get((p, v)):
            seen.add((code, brute_band(year, birth[p, v], "Unknown"), sex[p, v], year, p))
    for (p, v, _), year in brute_rest(data).items():
        band = brute_band(year, birth[p, v], None) if (p, v) in birth else None
        if band and sex.get((p, v)):
            seen.add(("!Q780", band, sex[p, v], year, p))
    expected = Counter(s[:3] for s in seen)

    cases = stage(op.cohort(c.diagnoses, "Q780", secondary=True, key=op.CONTRACT), "skew")
    rest = op.contract_years(op.remaining(c.diagnoses, cases))
    demo_cases = op.demographics(cases, c.vers, c.versq, op.CASE_RULES, prefilter=True)
    demo_rest = op.demographics(rest, c.vers, c.versq, op.REST_RULES)
    found = op.age_sex_case_control(demo_cases, demo_rest, "!Q780")
    assert rows(found) == sorted((*k, n) for k, n in expected.items())


def test_occurrence(case):
    c, data = case
    cases = brute_cases(data)
    linked = {(p, v, y) for (p, v, _), y in cases.items()}
    expected = set()
    for p, v, y, code, _ in confirmed(data):
        if (p, v, y) in linked:
            expected |= {(p, v, code, y)} if code == "R53" else set()
            expected |= {(p, v, code[:3], y)} if code[:3] in ("S72", "I10", "O30") or code.startswith("M796") else set()
    members = stage(op.cohort(c.diagnoses, "Q780", secondary=True, key=op.CONTRACT), "skew")
    assert rows(op.code_occurrence(c.diagnoses, members)) == sorted(expected)


@pytest.mark.parametrize("share", [0.0, 0.3])
def test_comorbidities(case, share):
    c, data = case
    base = {(p, y, code) for p, _, y, code, _ in data[0] if code in ("Q780", "I10")}
    other = {(p, y, code) for p, _, y, code, _ in data[0] if code not in ("Q780", "I10", "UUU")}
    counts = Counter((b, y, o) for p, y, b in base for q, z, o in other if (p, y) == (q, z))
    least = share * len({p for p, _, _ in base})
    kept = {k: n for k, n in counts.items() if n >= least}
    rank = {
        k: 1 + len({m for j, m in kept.items() if j[:2] == k[:2] and m > n}) for k, n in kept.items()
    }
    members = stage(op.cohort(c.outpatient, ["Q780", "I10"], confirmed_only=False, grain="distinct"), "skew")
    found = op.comorbidities(c.outpatient, members, ["Q780", "I10"], min_share=share)
    assert rows(found) == sorted((*k, n, rank[k]) for k, n in kept.items())


def test_row_counts(case):
    c, data = case
    persons = {p for p, _, _, code, _ in data[0] if code == "Q780"}
    counts = Counter(code for p, _, _, code, _ in data[0] if p in persons and code not in ("Q780", "UUU"))
    expected = sorted((k, n) for k, n in counts.items() if n >= 0.1 * len(persons))
    hits = stage(op.diagnosis_counts(op.filter_codes(c.outpatient, "Q780")), "skew")
    assert rows(op.comorbidity_row_counts(c.outpatient, hits, "Q780")) == expected
