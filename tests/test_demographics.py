from dataclasses import replace

import pytest

from prevalo import operators as op
from prevalo.constants import BANDS_EIGHT, BANDS_EVENT
from tests.conftest import rows


@pytest.fixture
def members(spark):
    data = [(p, 1, "Q780", 2015) for p in range(1, 9)]
    return spark.createDataFrame(data, "PSID long, VSID long, ICD_CODE string, BJAHR int")


@pytest.fixture
def masters(claims):
    return claims(
        vers=[
            (1, 1, 1990, "10115"),
            (1, 1, 1980, "01067"),  # lower year and text-lower postcode with a leading zero
            (2, 1, None, "20095"),
            (3, 1, 2000, ""),
            (3, 1, 2000, "10115"),  # blank sorts first
            (4, 1, 2000, None),
            (5, 1, 2000, "50667"),
            (6, 1, 2020, "60311"),  # born after the diagnosis
            (7, 2, 2000, "70173"),  # other contract only
            (8, 1, 2000, "80331"),
        ],
        versq=[
            (1, 1, 20151, 1),
            (1, 1, 20152, 0),  # one valid value: female
            (2, 1, 20151, 2),
            (3, 1, 20152, 2),
            (3, 1, 20151, 1),  # conflict
            (4, 1, 20151, None),
            (5, 1, 20151, 0),
            (6, 1, 20151, 2),
            (7, 1, 20151, 2),
            # person 8 has no quarterly row at all
        ],
    )


def test_master_rows_collapse_to_minima(masters):
    found = {r[0]: r[1:] for r in rows(op.insured(masters.vers))}
    assert found[1] == (1980, "01067")
    assert found[2] == (None, "20095")
    assert found[3] == (2000, "")
    assert found[4] == (2000, None)


def test_blank_postcode_can_be_missing(masters):
    found = {r[0]: r[2] for r in rows(op.insured(masters.vers, blank_plz_is_missing=True))}
    assert found[3] == "10115"


def test_sex_consensus(masters):
    found = {r[0]: r[2] for r in rows(op.sex_by_consensus(masters.versq, otherwise="Unknown"))}
    assert found == {1: "Female", 2: "Male", 3: "Unknown", 4: "Unknown", 5: "Unknown", 6: "Male", 7: "Male"}
    unset = {r[0]: r[2] for r in rows(op.sex_by_consensus(masters.versq))}
    assert unset[3] is None


def test_first_sex_follows_quarter_then_contract_then_code(claims):
    versq = claims(versq=[(1, 2, 20151, 2), (1, 1, 20151, 1), (1, 1, 20144, 0), (2, 2, 20151, 2), (2, 1, 20151, 1)]).versq
    assert rows(op.first_sex(versq)) == [(1, 0), (2, 1)]


def test_cases_need_a_known_sex_and_keep_unknown_ages(members, masters):
    found = op.demographics(members, masters.vers, masters.versq, op.CASE_RULES)
    assert rows(found, "PSID", "PLZ", "ALTER", "AGE_GROUP", "GESCHLECHT_LABEL") == [
        (1, "01067", 35, "19-49", "Female"),
        (2, "20095", None, "Unknown", "Male"),
        (6, "60311", -5, "Unknown", "Male"),
    ]


def test_rest_keeps_missing_sex_and_age_as_null(members, masters):
    found = op.demographics(members, masters.vers, masters.versq, op.REST_RULES)
    assert rows(found, "PSID", "AGE_GROUP", "GESCHLECHT_LABEL") == [
        (1, "19-49", "Female"),
        (2, None, "Male"),
        (3, "0-18", None),
        (4, "0-18", None),
        (5, "0-18", None),
        (6, None, "Male"),
        (8, "0-18", None),
    ]


def test_fixed_year_uses_person_and_first_entry(members, masters):
    rules = op.fixed_year_rules(2026)
    found = op.demographics(members.drop("VSID"), masters.vers, masters.versq, rules)
    assert rows(found, "PSID", "ALTER", "AGE_GROUP", "GESCHLECHT_LABEL") == [
        (1, 46, "18-59", "Female"),
        (2, None, "Unknown", "Male"),
        (3, 26, "18-59", "Female"),
        (4, 26, "18-59", "Unknown"),
        (5, 26, "18-59", "Unknown"),
        (6, 6, "0-17", "Male"),
        (7, 26, "18-59", "Male"),
    ]


def test_prefilter_changes_nothing(members, masters):
    for rules in (op.CASE_RULES, op.REST_RULES, op.fixed_year_rules(2026)):
        few = members.filter("PSID < 4")
        plain = op.demographics(few, masters.vers, masters.versq, rules)
        assert rows(op.demographics(few, masters.vers, masters.versq, rules, prefilter=True)) == rows(plain)


def test_unknown_sex_rule_is_refused(members, masters):
    with pytest.raises(ValueError, match="sex rule"):
        op.demographics(members, masters.vers, masters.versq, replace(op.CASE_RULES, sex="guess"))


def test_paired_demographics_multiply_by_different_values_only(spark, claims):
    members = spark.createDataFrame([(1, "A", 2000), (1, "A", 2001)], "PSID long, ICD_CODE string, BJAHR int")
    c = claims(
        vers=[(1, 1, 1950, "1"), (1, 2, 1950, "2"), (1, 2, 1960, "2"), (1, 1, None, "3")],
        versq=[(1, 1, 20001, 1), (1, 1, 20002, 1), (1, 1, 20003, 2), (1, 1, 20004, 0)],
    )
    found = op.paired_demographics(members, c.vers, c.versq, 2002)
    assert rows(found, "BJAHR", "GEBJAHR", "GESCHLECHT", "ALTER") == [
        (y, b, s, 2002 - b) for y in (2000, 2001) for b in (1950, 1960) for s in (1, 2)
    ]
    banded = op.paired_demographics(members, c.vers, c.versq, 2002, BANDS_EVENT)
    # 52 and 42 fall into two bands; with the wider bands below the two sexes remain.
    assert banded.count() == 2 * 2 * 2
    assert op.paired_demographics(members, c.vers, c.versq, 2002, ((0, None, "all"),)).count() == 2 * 2


def test_banded_pairs_count_persons(spark, claims):
    members = spark.createDataFrame([(p, "A", 2000) for p in (1, 2)], "PSID long, ICD_CODE string, BJAHR int")
    c = claims(
        vers=[(1, 1, 1950, "1"), (1, 1, 1951, "1"), (2, 1, 1952, "1")], versq=[(1, 1, 1, 1), (1, 1, 2, 1), (2, 1, 1, 1)]
    )
    demo = op.paired_demographics(members, c.vers, c.versq, 2002, BANDS_EIGHT)
    by_rows = rows(op.age_sex_distribution(demo))
    assert by_rows == rows(op.age_sex_distribution(demo, measure="persons")) == [("A", 2000, "50-59", "Female", 2)]


def test_person_demographics_take_the_least_pair(claims):
    c = claims(
        vers=[(1, 2, 1950, "2"), (1, 1, 1960, "1"), (2, 1, 1970, "3")],
        versq=[(1, 3, 20012, 2), (1, 4, 20011, 1), (3, 1, 20011, 1)],
    )
    found = op.person_demographics(c.vers, c.versq, 2002)
    assert rows(found) == [(1, 1, 1960, "1", 4, 20011, "Female", 42)]
