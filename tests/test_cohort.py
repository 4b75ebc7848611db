import pytest

from prevalo import operators as op
from tests.conftest import rows


@pytest.fixture
def sample(claims):
    return claims(
        amb=[
            (1, 1, 2016, "Q780", "G"),
            (1, 1, 2015, "Q780", "G"),
            (1, 1, 2014, "Q780", "V"),
            (1, 2, 2017, "I10", "G"),
            (2, 1, 2015, "Q780", "V"),
            (3, 1, 2015, "Q7801", "G"),
            (4, 1, 2015, "I10", "V"),
            (4, 1, 2016, "I10", "G"),
            (4, 1, 2016, "I10", "G"),
        ],
        kh=[
            (1, 1, 2015, "Q780", None),
            (5, 1, 2018, "Z251", "Q780"),
            (5, 1, 2019, "Q780", None),
            (6, 1, 2018, "Z251", None),
        ],
    )


def test_first_confirmed_year_over_both_sources(sample):
    assert rows(op.cohort(sample.diagnoses, "Q780")) == [(1, "Q780", 2015), (5, "Q780", 2019)]


def test_dotted_codes_are_normalised(sample):
    assert rows(op.cohort(sample.diagnoses, "Q78.0")) == rows(op.cohort(sample.diagnoses, "Q780"))


def test_prefix_cohort_keeps_each_code(sample):
    found = rows(op.cohort(sample.diagnoses, "Q78", exact=False))
    assert found == [(1, "Q780", 2015), (3, "Q7801", 2015), (5, "Q780", 2019)]


def test_secondary_match_keeps_the_primary_code_unless_relabelled(sample):
    kept = op.cohort(sample.diagnoses, "Q780", secondary=True, key=op.CONTRACT)
    assert rows(kept) == [(1, 1, "Q780", 2015), (5, 1, "Q780", 2019), (5, 1, "Z251", 2018)]
    relabelled = op.cohort(sample.diagnoses, "Q780", secondary=True, relabel=True, key=op.CONTRACT)
    assert rows(relabelled) == [(1, 1, "Q780", 2015), (5, 1, "Q780", 2018)]


def test_every_year_once_per_source_without_certainty(sample):
    found = rows(op.cohort(sample.diagnoses, "Q780", confirmed_only=False, grain="per_source"))
    # Person 1 has 2015 from both sources and keeps both rows.
    assert found == [
        (1, "Q780", 2014), (1, "Q780", 2015), (1, "Q780", 2015), (1, "Q780", 2016), (2, "Q780", 2015), (5, "Q780", 2019),
    ]


def test_outpatient_multi_code_cohort_is_distinct(sample):
    found = op.cohort(sample.outpatient, ["I10", "Q7801"], confirmed_only=False, grain="distinct")
    assert rows(found) == [(1, "I10", 2017), (3, "Q7801", 2015), (4, "I10", 2015), (4, "I10", 2016)]
    assert rows(op.cohort_size(found)) == [(3,)]


def test_code_list_cohort_equals_one_cohort_per_code(spark, sample):
    listed = ["Q780", "I10", "Z999"]
    frame = spark.createDataFrame([(c,) for c in listed + listed], "ICD_CODE string")
    single = [row for code in listed for row in rows(op.cohort(sample.diagnoses, code))]
    assert rows(op.cohort_for_list(sample.diagnoses, frame)) == sorted(single)


def test_remaining_excludes_by_person_and_keeps_first_years(sample):
    cases = op.cohort(sample.diagnoses, "Q780", secondary=True, key=op.CONTRACT)
    found = rows(op.remaining(sample.diagnoses, cases))
    # Contract 2 of person 1 leaves too; person 2 has only an unconfirmed code and no row.
    assert found == [(3, 1, "Q7801", 2015), (4, 1, "I10", 2016), (6, 1, "Z251", 2018)]


def test_remaining_rows_carry_their_number(sample):
    cases = op.cohort(sample.diagnoses, "Q780", confirmed_only=False, grain="per_source")
    found = op.remaining(sample.diagnoses, cases, confirmed_only=False, key=("PSID",), grain="rows")
    assert (4, "I10", 2016, 2) in rows(found)
    assert {r[0] for r in rows(found)} == {3, 4, 6}


def test_cohort_and_rest_share_nobody(sample):
    cases = op.cohort(sample.diagnoses, "Q780")
    rest = op.remaining(sample.diagnoses, cases)
    assert cases.join(rest, "PSID").isEmpty()


def test_unknown_grain_is_refused(sample):
    with pytest.raises(ValueError, match="grain"):
        op.cohort(sample.diagnoses, "Q780", grain="weekly")


def test_filter_codes(sample):
    assert op.filter_codes(sample.ambdiag, "Q78", column="ICDAMB_CODE").count() == 5
    assert op.filter_codes(sample.ambdiag, "Q780", exact=True, column="ICDAMB_CODE").count() == 4
