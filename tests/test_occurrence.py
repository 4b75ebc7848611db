import pytest

from prevalo import operators as op
from tests.conftest import rows

MEMBERS = "PSID long, VSID long, ICD_CODE string, BJAHR int"


def groups(df):
    return rows(df, "PSID", "ICD_GROUP", "BJAHR")


def test_prefix_codes_leave_out_exact_ones_in_order(spark):
    assert op.prefix_codes(["S02", "R53", "I10", "S02"], ["R53"]) == ["S02", "I10"]
    tracked = spark.createDataFrame([("S02",), ("R53",), ("I10",), ("S02",)], "ICD_CODE string")
    exact = spark.createDataFrame([("R53",)], "ICD_CODE string")
    assert rows(op.code_difference(tracked, exact)) == [("I10",), ("S02",)]


def test_code_in_both_lists_gives_both_groups(claims):
    c = claims(amb=[(1, 1, 2015, "T733", "G"), (1, 1, 2015, "R530", "G"), (1, 1, 2015, "M7980", "G")])
    found = op.code_occurrence(c.diagnoses, tracked=["T73", "T733", "M798"], exact=["T733", "R53"])
    # R530 is no exact R53; a four-character prefix still groups by three characters.
    assert groups(found) == [(1, "M79", 2015), (1, "T73", 2015), (1, "T733", 2015)]


@pytest.fixture
def case(spark):
    return spark.createDataFrame([(1, 1, "Q780", 2015)], MEMBERS)


def test_default_link_counts_the_first_case_year_only(spark, claims, case):
    c = claims(amb=[(1, 1, 2015, "Q780", "G"), (1, 1, 2017, "Q780", "G"), (1, 1, 2017, "S7200", "G")])
    assert groups(op.code_occurrence(c.diagnoses, case)) == []
    every_year = op.cohort(c.diagnoses, "Q780", key=op.CONTRACT, grain="distinct")
    assert groups(op.code_occurrence(c.diagnoses, every_year, link="same_year")) == [(1, "S72", 2017)]
    assert groups(op.code_occurrence(c.diagnoses, case, link="any_year")) == [(1, "S72", 2017)]


def test_link_needs_the_contract(claims, case):
    c = claims(amb=[(1, 2, 2015, "S7200", "G"), (1, 1, 2015, "S8200", "G")], kh=[(1, 1, 2015, "S9200", None)])
    assert groups(op.code_occurrence(c.diagnoses, case)) == [(1, "S82", 2015), (1, "S92", 2015)]


def test_certainty_covers_all_prefixes_unless_legacy(claims, case):
    c = claims(
        amb=[
            (1, 1, 2015, "S0220", "V"),
            (1, 1, 2015, "O300", "V"),
            (1, 1, 2015, "R53", "V"),
            (1, 1, 2015, "S1200", "G"),
        ],
        kh=[(1, 1, 2015, "I1000", None)],
    )
    assert groups(op.code_occurrence(c.diagnoses, case)) == [(1, "I10", 2015), (1, "S12", 2015)]
    # The test binds to the last prefix (O30) only, so the unconfirmed S02 slips through.
    legacy = op.code_occurrence(c.diagnoses, case, legacy_precedence=True)
    assert groups(legacy) == [(1, "I10", 2015), (1, "S02", 2015), (1, "S12", 2015)]


def test_occurrence_counts_person_years_with_known_sex_and_age(spark, claims):
    c = claims(
        vers=[(1, 1, 2000, "1"), (1, 2, 2000, "1"), (2, 1, None, "1"), (3, 1, 2000, "1")],
        versq=[(1, 1, 1, 1), (1, 2, 1, 1), (2, 1, 1, 1), (3, 1, 1, 0)],
    )
    found = spark.createDataFrame(
        [(1, 1, "S72", 2015), (1, 2, "S72", 2015), (1, 1, "S72", 2016), (2, 1, "S72", 2015), (3, 1, "S72", 2015)],
        "PSID long, VSID long, ICD_GROUP string, BJAHR int",
    )
    counted = op.occurrence_age_sex(found, op.profiles(c.vers, c.versq))
    # Two contracts in one year are one person; two years are two.
    assert rows(counted) == [("S72", "Female", "0-18", 2)]


def test_cohort_demographics_keep_persons_without_any(spark):
    found = spark.createDataFrame(
        [(1, "S72", 2015), (2, "S72", 2015)], "PSID long, ICD_GROUP string, BJAHR int"
    )
    demo = spark.createDataFrame(
        [(1, "Male", "0-19"), (1, "Male", "0-19"), (1, "Male", "20-39")],
        "PSID long, GESCHLECHT_LABEL string, AGE_GROUP string",
    )
    assert rows(op.occurrence_for_cohort_demographics(found, demo)) == [
        ("S72", 2015, None, None, 1), ("S72", 2015, "Male", "0-19", 1), ("S72", 2015, "Male", "20-39", 1),
    ]
