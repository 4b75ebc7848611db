"""Reports against the registered queries, whose results are checked elsewhere."""

import os
from pathlib import Path

import pytest

from prevalo.catalogue import queries as registry
from prevalo.catalogue.claims_views import claims_from_star
from prevalo.plans import (
    case_control_report,
    fixed_year_report,
    multi_code_report,
    single_code_report,
    tracer_report,
    write_report,
)
from prevalo.sources import store_claims
from tests.conftest import rows
from tests.test_differential import SF_DIR

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def c(spark, tmp_path_factory):
    return store_claims(claims_from_star(spark, SF_DIR), str(tmp_path_factory.mktemp("claims")))


def assert_same(report, **expected):
    for table, query in expected.items():
        found = report[table]
        assert rows(found, *sorted(found.columns)) == rows(query, *sorted(query.columns)), table


def test_case_control_report(c):
    q = registry.QUERIES
    assert_same(
        case_control_report(c, "Q78.0"),
        RT_RD_NON_RD_AGE_SEX_DIST=q["age_sex_case_control"](c),
        RT_SPECIFIC_ICD_AGE_SEX_DIST=q["specific_icd_rd"](c),
        RT_SPECIFIC_ICD_AGE_SEX_DIST_REMAIN=q["specific_icd_remaining"](c),
        RT_PLZ_OI_NON_OI_SEX=q["plz_case_control"](c),
    )


def test_case_control_links_only_add_counts(c):
    table = "RT_SPECIFIC_ICD_AGE_SEX_DIST"
    count = {
        link: case_control_report(c, "Q780", link=link)[table].groupBy().sum("CNT_D_PSID").first()[0]
        for link in ("first_year", "same_year", "any_year")
    }
    assert count["first_year"] <= count["same_year"] <= count["any_year"]


def test_tracer_report(c):
    q = registry.QUERIES
    assert_same(
        tracer_report(c, registry._code_list(c), registry.YEAR),
        ALL_age_sex_dist=q["age_sex_by_code"](c),
        ALL_plz_dist=q["plz1_by_code"](c),
    )


def test_fixed_year_report(c):
    q = registry.QUERIES
    assert_same(
        fixed_year_report(c, "Q780", registry.YEAR),
        RT_RD_AGE_SEX_DIST=q["age_sex_4band"](c),
        RT_REMAINING_POP_AGE_SEX_DIST=q["age_sex_4band_remaining"](c),
        RT_RD_PLZ_GROUPED=q["plz2_dist"](c),
        RT_SPECIFIC_ICD_AGE_SEX_DIST=q["specific_icd_left"](c),
    )


def test_multi_code_report(c, tmp_path):
    q = registry.QUERIES
    report = multi_code_report(c, registry.SEVERAL, registry.YEAR, min_share=0.01)
    assert_same(
        report,
        RT_AGE_SEX_DIST=q["age_sex_8band"](c),
        RT_AGE_SEX_DIST_TOT=q["age_sex_remaining"](c),
        RT_COMORBIDITIES=q["comorbidity_top20"](c),
    )
    older = multi_code_report(c, registry.SEVERAL, registry.YEAR, every_master_row=True)
    assert_same(older, RT_AGE_SEX_DIST=q["age_sex_8band_persons"](c))
    write_report(report, str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == set(report)


def test_written_postcodes_start_with_the_largest(c, spark, tmp_path):
    write_report(fixed_year_report(c, "Q780", registry.YEAR), str(tmp_path), single_file=True)
    (part,) = (tmp_path / "RT_RD_PLZ_GROUPED").glob("*.csv")
    counts = [int(line.rsplit(",", 1)[1]) for line in part.read_text().splitlines()[1:]]
    assert len(counts) > 1 and counts == sorted(counts, reverse=True)


def test_single_code_report(c):
    q = registry.QUERIES
    labels = registry._labels(c).selectExpr("year + 20 AS year", "icd_sub", "label")
    report = single_code_report(c, labels, "q78.0", years="2019,2020", reference_year=registry.YEAR)
    assert_same(
        report,
        age_sex_hist=q["dm_age_histogram"](c),
        sex_dist=q["dm_sex_share"](c),
        top_comorbidities=q["dm_comorbidities"](c),
        top20_comorbidities=q["dm_top20_labelled"](c),
        top_codes=q["dm_labelled_codes"](c),
    )
    # A code is listed from a tenth of the persons on.
    persons = c.ambdiag.filter("ICDAMB_CODE = 'Q780'").select("PSID").distinct().count()
    assert min(r.n for r in report["top_codes"].collect()) >= 0.1 * persons


def test_single_code_report_without_a_match(c):
    with pytest.raises(ValueError, match="no diagnosis"):
        single_code_report(c, registry._labels(c), "ZZZ")


def cases_of(report, table, column="ICD_CODE"):
    return {r[column] for r in report[table].select(column).distinct().collect()}


def test_no_report_drops_a_code_of_several(c):
    two = ["Q78.0", "Q783"]
    assert cases_of(case_control_report(c, two), "RT_RD_NON_RD_AGE_SEX_DIST") >= {"Q780", "Q783", "!Q780, Q783"}
    assert cases_of(fixed_year_report(c, two, registry.YEAR), "RT_RD_AGE_SEX_DIST") == {"Q780", "Q783"}
    assert cases_of(multi_code_report(c, two, registry.YEAR), "RT_AGE_SEX_DIST", "ICDAMB_CODE") == {"Q780", "Q783"}
    with pytest.raises(ValueError, match="one code"):
        single_code_report(c, registry._labels(c), two)


def test_rest_of_several_codes_is_without_any_of_them(c):
    one, other, both = (
        case_control_report(c, codes)["RT_RD_NON_RD_AGE_SEX_DIST"].filter("ICD_CODE LIKE '!%'").groupBy().sum("CNT_D_PSID").first()[0]
        for codes in ("Q780", "Q783", ["Q780", "Q783"])
    )
    assert both < min(one, other)


def test_written_reports_leave_nothing_staged(c, tmp_path):
    report = case_control_report(c, "Q780")
    folder = Path(report.staged.removeprefix("file://"))
    assert any(folder.iterdir())
    write_report(report, str(tmp_path), "parquet")
    assert not folder.exists() and (tmp_path / "RT_PLZ_OI_NON_OI_SEX").exists()


def test_dictionary_names_the_parameters(c):
    def text(**options):
        entries = multi_code_report(c, registry.SEVERAL, registry.YEAR, **options)["DD_RESULT_TABLES"]
        return entries.filter("TABELLENNAME = 'RT_COMORBIDITIES'").first().BESCHREIBUNG

    assert text() == "Top 20 Komorbiditäten (≥10% Prävalenz) für ICD-10: C222, C728, C812, C817"
    assert text(min_share=0.01, top_n=5).startswith("Top 5 Komorbiditäten (≥1% Prävalenz)")


def test_a_tracer_needs_a_year(c):
    with pytest.raises(ValueError, match="fixed year"):
        tracer_report(c, registry._code_list(c), None)
