"""Plan shapes that matter at scale."""

import contextlib
import re

import pytest

from prevalo import operators as op
from prevalo.sources import code_frame, read_code_list, stage, store_claims
from tests.test_differential import plan_of


@pytest.fixture
def stored(claims, tmp_path):
    amb = [(p, 1, 2015, code, "G") for p in range(50) for code in ("Q780", "I10", "S720")]
    c = claims(
        amb=amb,
        kh=[(p, 1, 2015, "I10", None) for p in range(50)],
        vers=[(p, 1, 1990, "01067") for p in range(50)],
        versq=[(p, 1, 20151, 1) for p in range(50)],
    )
    return store_claims(c, str(tmp_path))


@contextlib.contextmanager
def broadcasting(spark, threshold):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, threshold)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scans(plan, column):
    """Scans that read the column."""
    return len(re.findall(rf"FileScan parquet \[[^\]]*{column}", plan))


def depth_first(plan, *names):
    """The first plan line that names each operator."""
    lines = plan.splitlines()
    return [next(i for i, line in enumerate(lines) if re.search(name, line)) for name in names]


def test_small_cohort_filters_before_the_aggregation(spark, stored):
    cases = stage(op.cohort(stored.diagnoses, "Q780"), "plan-cases")
    plan = plan_of(op.remaining(stored.diagnoses, cases))
    last_aggregate = max(i for i, line in enumerate(plan.splitlines()) if "Aggregate" in line)
    assert depth_first(plan, "BroadcastHashJoin.*LeftAnti")[0] > last_aggregate
    assert "SortMergeJoin" not in plan


def test_large_cohort_meets_reduced_rows(spark, stored):
    cases = stage(op.cohort(stored.diagnoses, "Q780"), "plan-cases")
    with broadcasting(spark, -1):
        plan = plan_of(op.remaining(stored.diagnoses, cases))
    join, aggregate = depth_first(plan, "SortMergeJoin.*LeftAnti", "Aggregate")
    assert join < aggregate and "Broadcast" not in plan


def test_prefilter_reaches_below_both_master_aggregations(spark, stored):
    cases = stage(op.cohort(stored.diagnoses, "Q780"), "plan-cases")
    for rules in (op.fixed_year_rules(2026), op.REST_RULES):
        members = cases if rules.key == op.PERSON else stage(op.cohort(stored.diagnoses, "Q780", key=op.CONTRACT), "c")
        plan = plan_of(op.profiles(stored.vers, stored.versq, rules, members))
        branches = re.findall(r"Aggregate|LeftSemi", plan)
        assert branches.count("LeftSemi") == 2
        assert branches[0] == "Aggregate" and branches[-1] == "LeftSemi", plan


def test_code_list_cohort_scans_each_source_once(spark, stored):
    plan = plan_of(op.cohort_for_list(stored.diagnoses, code_frame(spark, ["Q780", "I10"])))
    assert (scans(plan, "ICDAMB_CODE"), scans(plan, "ICDKH_CODE")) == (1, 1)
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_tracked_codes_scan_each_source_once(spark, stored):
    plan = plan_of(op.code_occurrence(stored.diagnoses))
    assert (scans(plan, "ICDAMB_CODE"), scans(plan, "ICDKH_CODE")) == (1, 1)


def test_code_and_certainty_tests_reach_the_scan(spark, stored):
    plan = plan_of(op.cohort(stored.diagnoses, "Q780"))
    assert "EqualTo(ICDAMB_CODE,Q780)" in plan and "EqualTo(DIAGSICH,G)" in plan and "EqualTo(ICDKH_CODE,Q780)" in plan
    assert "SEKICD_CODE" not in plan and "VSID" not in plan
    assert "StringStartsWith(ICDAMB_CODE,S72)" in plan_of(op.cohort(stored.diagnoses, "S72", exact=False))


def test_first_sex_needs_no_window(spark, stored):
    assert "Window" not in plan_of(op.first_sex(stored.versq))


def test_consensus_is_one_hash_aggregation(spark, stored):
    plan = plan_of(op.sex_by_consensus(stored.versq))
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1


def test_contract_years_share_their_shuffle_with_the_join(spark, stored):
    cases = stage(op.cohort(stored.diagnoses, "Q780", key=op.CONTRACT), "plan-cases")
    with broadcasting(spark, -1):
        years = op.contract_years(op.remaining(stored.diagnoses, cases))
        plan = plan_of(op.demographics(years, stored.vers, stored.versq, op.REST_RULES))
    # Reduction, anti-join and contract years on the left, the cohort's persons, two master tables.
    assert plan.count("Exchange hashpartitioning") == 6


def test_code_list_from_a_file_filters_the_scan(spark, stored, tmp_path):
    (tmp_path / "list.csv").write_text("CODE;TEXT;O;T;L\nQ78.0;t;1;n;l\n")
    listed = stage(read_code_list(spark, str(tmp_path / "list.csv")).select("ICD_CODE"), "listed")
    plan = plan_of(op.cohort_for_list(stored.diagnoses, listed))
    join, aggregate = depth_first(plan, "BroadcastHashJoin.*LeftSemi", "Aggregate")
    assert join > aggregate and not re.search(r"Exchange hashpartitioning\(ICD_CODE#\d+,", plan)


def test_bucketed_masters_and_rest_are_not_shuffled(spark, stored, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/db'")
    c = store_claims(stored, str(tmp_path / "b"), database="bucketed", buckets=4)
    with broadcasting(spark, -1):
        assert "Exchange" not in plan_of(op.profiles(c.vers, c.versq, op.REST_RULES))
        profile = stage(op.profiles(c.vers, c.versq, op.REST_RULES), "profiles", bucket_by=op.CONTRACT)
        cases = stage(op.cohort(c.diagnoses, "S720", key=op.CONTRACT), "cases")
        rest = stage(op.remaining(c.diagnoses, cases), "rest", bucket_by=op.CONTRACT)
        plan = plan_of(op.describe(op.contract_years(rest, partitioned=True), profile, op.REST_RULES))
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    spark.sql("DROP DATABASE bucketed CASCADE")
