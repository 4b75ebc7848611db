import pytest

from prevalo import operators as op
from tests.conftest import rows


@pytest.fixture
def ten_cases(claims):
    """Ten persons with E849 in 2015; code X in all, Y in one, Z in another year."""
    amb = []
    for person in range(1, 11):
        amb += [(person, 1, 2015, "E849", "G"), (person, 1, 2015, "X", "V"), (person, 1, 2015, "UUU", "G")]
    amb += [(1, 1, 2015, "X", "G"), (1, 1, 2015, "Y", "G"), (1, 1, 2016, "Z", "G"), (11, 1, 2015, "Y", "G")]
    return claims(amb=amb)


def cohort(c, *codes):
    return op.cohort(c.outpatient, codes, confirmed_only=False, grain="distinct")


def test_persons_are_counted_once_in_the_same_year(ten_cases):
    found = op.comorbidities(ten_cases.outpatient, cohort(ten_cases, "E849"), "E849")
    assert rows(found) == [("E849", 2015, "X", 10, 1), ("E849", 2015, "Y", 1, 2)]


def test_minimum_share_is_rounded_up(ten_cases):
    found = op.comorbidities(ten_cases.outpatient, cohort(ten_cases, "E849"), "E849", min_share=0.11)
    assert rows(found, "ICDAMB_CODE_COMORBID") == [("X",)]


def test_minimum_uses_all_cohort_persons_unless_scoped(claims):
    amb = [(p, 1, 2015, "A", "G") for p in range(1, 21)] + [(30, 1, 2016, "B", "G"), (30, 1, 2016, "C", "G")]
    c = claims(amb=amb)
    members = cohort(c, "A", "B")
    assert rows(op.comorbidities(c.outpatient, members, ["A", "B"])) == []
    scoped = op.comorbidities(c.outpatient, members, ["A", "B"], threshold_scope="base_year")
    assert rows(scoped) == [("B", 2016, "C", 1, 1)]
    with pytest.raises(ValueError, match="scope"):
        op.comorbidities(c.outpatient, members, ["A"], threshold_scope="year")


def test_ties_share_a_rank_and_may_exceed_the_top(claims):
    amb = [(1, 1, 2015, "E849", "G"), (2, 1, 2015, "E849", "G")]
    amb += [(1, 1, 2015, f"T{n:02d}", "G") for n in range(25)]
    amb += [(p, 1, 2015, "BOTH", "G") for p in (1, 2)]
    c = claims(amb=amb)
    found = op.comorbidities(c.outpatient, cohort(c, "E849"), "E849", top_n=2)
    ranks = [r[0] for r in rows(found, "RN")]
    assert len(ranks) == 26 and sorted(set(ranks)) == [1, 2] and ranks.count(2) == 25


def test_row_counts_compare_rows_with_persons(claims):
    amb = [(p, 1, 2015, "E849", "G") for p in range(1, 11)]
    amb += [(1, 1, 2015, "X", "G"), (2, 1, 2016, "Y", "G"), (2, 1, 2017, "Y", "G"), (99, 1, 2015, "X", "G")]
    amb += [(1, 1, 2015, None, "G"), (1, 1, 2015, None, "G"), (1, 1, 2015, "UUU", "G")]
    c = claims(amb=amb)
    persons = c.ambdiag.filter("PSID < 50").select("PSID").distinct()
    assert rows(op.comorbidity_row_counts(c.outpatient, persons, "E849")) == [("X", 1), ("Y", 2)]
    assert rows(op.comorbidity_row_counts(c.outpatient, persons, "E849", min_share=0.2)) == [("Y", 2)]


@pytest.fixture
def labels(spark):
    data = [(2018, "X", "old"), (2019, "X", "new"), (2020, "X", "newer"), (2019, "Y", "why")]
    return spark.createDataFrame(data, "year int, icd_sub string, label string")


def test_labels_join_once_per_code_with_the_latest_year(spark, labels):
    counts = spark.createDataFrame([("X", 5), ("Y", 5), ("Z", 9)], "ICDAMB_CODE string, n long")
    two = op.top_labelled(counts, labels, [2019, 2020], n=2)
    assert rows(two) == [("X", 5, "newer"), ("Z", 9, None)]
    every = op.labelled_codes(counts, labels, [2019])
    assert every.columns == ["ICD_codes", "n", "label"]
    assert rows(every) == [("X", 5, "new"), ("Y", 5, "why"), ("Z", 9, None)]
