"""The reports: each answers all its questions from a few staged tables.

A report stages what it reads more than once. Cohorts are small, so they are broadcast to
the next scan when their exact size allows; the remaining population is large and staged
in reduced form, one row per person, contract and code.
"""

from collections.abc import Callable, Iterable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prevalo import operators as op
from prevalo.constants import (
    BANDS_ADULT,
    BANDS_EIGHT,
    BANDS_FOUR,
    TRACKED_CODES,
    TRACKED_CODES_SHORT,
    TRACKED_EXACT,
    TRACKED_EXACT_SHORT,
)
from prevalo.functions import normalise_codes
from prevalo.plans.settings import label_years
from prevalo.sources import Claims, clear_staged, code_frame, stage, staging_scope, write_result


class Report(dict[str, DataFrame]):
    """Result tables by name, and the folder of what they were staged from."""

    staged: str | None = None


def _report(build: Callable[..., dict[str, DataFrame]]) -> Callable[..., Report]:
    """Keeps what a report stages in a folder of its own."""

    @wraps(build)
    def scoped(claims: Claims, *args, **options) -> Report:
        with staging_scope(claims.outpatient.sparkSession) as folder:
            report = Report(build(claims, *args, **options))
        report.staged = folder
        return report

    return scoped


# Columns that order a written result; a leading minus sorts descending.
ORDERINGS = {
    "ALL_age_sex_dist": ("ICD_CODE", "BJAHR", "ALTERSGRUPPE", "GESCHLECHT_LABEL"),
    "ALL_plz_dist": ("ICD_CODE", "-CNT_D_PSID", "PLZ"),
    "RT_COMORBIDITIES": ("ICDAMB_CODE_BASE", "BJAHR", "RN", "ICDAMB_CODE_COMORBID"),
    "RT_PLZ_OI_NON_OI_SEX": ("-CNT_D_PSID_TOTAL", "PLZ"),
    "RT_RD_PLZ_GROUPED": ("-CNT_D_PSID", "PLZ2"),
    "RT_SPECIFIC_ICD_AGE_SEX_DIST": ("ICD_GROUP", "GESCHLECHT_LABEL", "AGE_GROUP"),
    "RT_SPECIFIC_ICD_AGE_SEX_DIST_REMAIN": ("ICD_GROUP", "GESCHLECHT_LABEL", "AGE_GROUP"),
    "top20_comorbidities": ("-n", "ICDAMB_CODE"),
    "top_codes": ("ICD_codes",),
}


def write_report(report: Report, root: str, fmt: str = "csv", single_file: bool = False) -> None:
    """Write every table of a report under ``root``, in the order readers expect, and clear its staged tables."""
    for name, table in report.items():
        ordering = [F.desc(c[1:]) if c.startswith("-") else c for c in ORDERINGS.get(name, ())]
        write_result(table, f"{root}/{name}", fmt, order_by=ordering, single_file=single_file)
    if getattr(report, "staged", None) and report:
        clear_staged(next(iter(report.values())).sparkSession, report.staged)
        report.staged = None


def _outpatient(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("ICD_CODE", "ICDAMB_CODE")


@_report
def tracer_report(claims: Claims, code_list: DataFrame, reference_year: int, plz_digits: int = 1) -> Report:
    """Age × sex and first postcode digits (one or two) of every code of a list, in one pass.

    The persons of a whole list are nearly everyone, so the master tables are not filtered by them.
    """
    rules = op.fixed_year_rules(reference_year, BANDS_ADULT)
    listed = stage(code_list.select("ICD_CODE").distinct(), "codes")
    cohorts = op.cohort_for_list(claims.diagnoses, listed)
    demo = stage(op.demographics(cohorts, claims.vers, claims.versq, rules), "tracer-demographics")
    return {
        "ALL_age_sex_dist": op.age_sex_distribution(demo),
        "ALL_plz_dist": op.plz_distribution(demo, plz_digits, ("ICD_CODE",)),
    }


@_report
def case_control_report(
    claims: Claims,
    code: str | Iterable[str],
    *,
    exact: bool = True,
    tracked: Iterable[str] = TRACKED_CODES,
    tracked_exact: Iterable[str] = TRACKED_EXACT,
    link: str = "first_year",
    legacy_precedence: bool = False,
    plz_digits: int | None = None,
    case_tag: str = "OI",
) -> Report:
    """A rare disease against everyone else: age × sex, tracked codes, postcodes.

    Several codes are one group of cases, each under its own code in the tables; the rest is
    everyone without any of them.

    ``link`` other than ``first_year`` links tracked codes to every year of the disease
    and takes the remaining population's codes from every year too.
    """
    code = normalise_codes(code)
    base = {"exact": exact, "secondary": True, "key": op.CONTRACT}
    cases = stage(op.cohort(claims.diagnoses, code, **base), "cases")
    # Both are as large as the population and meet by contract: in buckets they are shuffled once, here.
    rest = stage(op.remaining(claims.diagnoses, cases), "rest", bucket_by=op.CONTRACT)
    profile = stage(op.profiles(claims.vers, claims.versq, op.REST_RULES), "profiles", bucket_by=op.CONTRACT)
    demo_cases = op.describe(cases, profile, op.CASE_RULES)
    years = op.contract_years(rest, partitioned=True)
    demo_rest = stage(op.describe(years, profile, op.REST_RULES), "demographics-rest")

    if link == "first_year":
        linked, rest_events = cases, rest
    else:
        linked = stage(op.cohort(claims.diagnoses, code, grain="distinct", **base), "cases-all-years")
        rest_events = op.remaining(claims.diagnoses, cases, grain="distinct")
    lists = {"tracked": tracked, "exact": tracked_exact}
    found = op.code_occurrence(
        claims.diagnoses, linked, link=link, legacy_precedence=legacy_precedence, **lists
    )
    return {
        "RT_RD_NON_RD_AGE_SEX_DIST": op.age_sex_case_control(demo_cases, demo_rest, "!" + ", ".join(code)),
        "RT_SPECIFIC_ICD_AGE_SEX_DIST": op.occurrence_age_sex(found, profile),
        "RT_SPECIFIC_ICD_AGE_SEX_DIST_REMAIN": op.occurrence_age_sex(op.code_occurrence(rest_events, **lists), profile),
        "RT_PLZ_OI_NON_OI_SEX": op.plz_case_control(demo_cases, demo_rest, plz_digits, case_tag),
    }


@_report
def fixed_year_report(
    claims: Claims,
    code: str | Iterable[str],
    reference_year: int,
    *,
    exact: bool = True,
    tracked: Iterable[str] = TRACKED_CODES_SHORT,
    tracked_exact: Iterable[str] = TRACKED_EXACT_SHORT,
) -> Report:
    """The older case report: every diagnosis year, no certainty test, age in a fixed year."""
    cases = stage(op.cohort(claims.diagnoses, code, exact=exact, confirmed_only=False, grain="per_source"), "cases")
    rules = op.fixed_year_rules(reference_year, BANDS_FOUR)
    profile = stage(op.profiles(claims.vers, claims.versq, rules), "profiles")
    demo_cases = op.describe(cases, profile, rules)
    rest = op.remaining(claims.diagnoses, cases, confirmed_only=False, key=op.PERSON, grain="rows")
    found = op.code_occurrence(
        claims.diagnoses.drop("VSID"),
        cases,
        tracked=tracked,
        exact=tracked_exact,
        link="any_year",
        confirmed_only=False,
    )
    return {
        "RT_RD_AGE_SEX_DIST": op.age_sex_distribution(demo_cases),
        "RT_SPECIFIC_ICD_AGE_SEX_DIST": op.occurrence_for_cohort_demographics(found, demo_cases),
        "RT_REMAINING_POP_AGE_SEX_DIST": op.age_sex_distribution(op.describe(rest, profile, rules)),
        "RT_RD_PLZ_GROUPED": op.plz_distribution(demo_cases, 2, name="PLZ2"),
    }


@_report
def multi_code_report(
    claims: Claims,
    codes: str | Iterable[str],
    reference_year: int,
    *,
    exact: bool = True,
    min_share: float = 0.10,
    top_n: int = 20,
    every_master_row: bool = False,
) -> Report:
    """Outpatient cohort of several codes: age × sex, comorbidities, the rest, dictionary.

    ``every_master_row`` counts a person under each of its birth years and sexes, as the
    older form of the report does, instead of one of each.
    """
    listed = normalise_codes(codes)
    vers, versq = claims.vers, claims.versq
    members = stage(
        op.cohort(claims.outpatient, listed, exact=exact, confirmed_only=False, grain="distinct"), "members"
    )
    if every_master_row:
        demo = op.paired_demographics(members, vers, versq, reference_year, BANDS_EIGHT, prefilter=True)
    else:
        rules = op.fixed_year_rules(reference_year, BANDS_EIGHT)
        demo = op.demographics(members, vers, versq, rules, prefilter=True)
    rest = op.remaining(claims.outpatient, members, confirmed_only=False, key=op.PERSON, grain="distinct")
    demo_rest = op.paired_demographics(rest, vers, versq, reference_year, BANDS_EIGHT)
    spark = members.sparkSession
    return {
        "RT_AGE_SEX_DIST": _outpatient(op.age_sex_distribution(demo)),
        "RT_COMORBIDITIES": op.comorbidities(claims.outpatient, members, listed, min_share=min_share, top_n=top_n),
        "RT_AGE_SEX_DIST_TOT": _outpatient(op.age_sex_distribution(demo_rest)),
        "DD_RESULT_TABLES": op.table_entries(code_frame(spark, listed), min_share, top_n),
        "DD_RESULT_COLS": op.column_entries(spark),
    }


@_report
def single_code_report(
    claims: Claims,
    labels: DataFrame,
    code: str,
    *,
    exact: bool = False,
    years: str | Iterable[int] = "2019",
    reference_year: int | None = None,
    latest_year: int | None = None,
    min_share: float = 0.10,
    dedupe: bool = False,
) -> Report:
    """One code from outpatient diagnoses: age histogram, sex share, frequent other codes.

    ``labels`` holds year, icd_sub and label. More than one code, and a code that no
    diagnosis carries, is an error.
    """
    catalogue = label_years(years, latest_year)
    code, *more = normalise_codes(code, upper=True)
    if more:
        raise ValueError(f"one code is needed, got also {more!r}")
    found = op.filter_codes(claims.outpatient, code, exact)
    hits = stage(op.diagnosis_counts(found), "diagnosis-counts")
    if hits.isEmpty():
        raise ValueError(f"no diagnosis matches {code!r} ({'exact' if exact else 'prefix'} match)")
    diagnosed = stage(op.diagnosed_persons(hits, claims.vers, claims.versq, reference_year), "diagnosed")
    counts = stage(
        op.comorbidity_row_counts(claims.outpatient, diagnosed, code, min_share=min_share), "comorbidities"
    )
    return {
        "age_sex_hist": op.age_histogram(diagnosed, dedupe=dedupe),
        "sex_dist": op.sex_share(diagnosed, dedupe=dedupe),
        "top_comorbidities": counts,
        "top20_comorbidities": op.top_labelled(counts, labels, catalogue),
        "top_codes": op.labelled_codes(counts, labels, catalogue),
    }
