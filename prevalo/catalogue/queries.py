"""Registered queries: one function per operator, from claims tables to a result."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prevalo import operators as op
from prevalo.catalogue.claims_views import claims_from_star
from prevalo.constants import BANDS_EIGHT, BANDS_FOUR, TRACKED_CODES_SHORT, TRACKED_EXACT, TRACKED_EXACT_SHORT
from prevalo.functions import normalise_code, normalise_codes
from prevalo.plans import (
    case_control_report,
    fixed_year_report,
    multi_code_report,
    single_code_report,
    tracer_report,
    write_report,
)
from prevalo.plans.settings import result_folder
from prevalo.sources import Claims, code_frame, read_claims, read_claims_tables, read_code_list, stage, write_result
from prevalo.sources.staging import staging_root
from prevalo.streaming import first_years, update_first_years

RARE = "Q780"
TWO = ("Q780", "Q783")
SEVERAL = ("C222", "C728", "C812", "C817")
FAMILY = "E849"
YEAR = 2002
LABEL_YEARS = (1999, 2000)
# A code list with dots, absent codes and codes that start with others.
LISTED = ("Q78.0", "E84.9", "S72.00", "I10.00", "R53", "N39.0", "B99", "A00.0", "Z99.9")
PREFIXES = ("Q78", "R53", "R53.0", "S", "E84.90", "X1")

QUERIES: dict[str, Callable[[Claims], DataFrame]] = {}


def registered(query: Callable[[Claims], DataFrame]) -> Callable[[Claims], DataFrame]:
    QUERIES[query.__name__] = query
    return query


# --- shared steps -------------------------------------------------------------------------


def _cases(c: Claims, **options) -> DataFrame:
    """The rare-disease cohort per person and contract, staged because it is read often."""
    return stage(op.cohort(c.diagnoses, RARE, secondary=True, key=op.CONTRACT, **options), "cases")


def _legacy_cases(c: Claims) -> DataFrame:
    """Every year, once per source, no certainty test."""
    return stage(op.cohort(c.diagnoses, RARE, confirmed_only=False, grain="per_source"), "legacy-cases")


def _several(c: Claims, **options) -> DataFrame:
    """The multi-code outpatient cohort."""
    options = {"exact": True, "confirmed_only": False, "grain": "distinct", **options}
    return op.cohort(c.outpatient, SEVERAL, **options)


def _case_control(c: Claims) -> tuple[DataFrame, DataFrame]:
    """Demographics of cases and rest from one set of profiles, whose shuffles are reused."""
    cases = _cases(c)
    profile = op.profiles(c.vers, c.versq, op.REST_RULES)
    years = op.contract_years(op.remaining(c.diagnoses, cases))
    return op.describe(cases, profile, op.CASE_RULES), op.describe(years, profile, op.REST_RULES)


def _fixed_year(c: Claims, members: DataFrame, *bands, prefilter: bool = False) -> DataFrame:
    return op.demographics(members, c.vers, c.versq, op.fixed_year_rules(YEAR, *bands), prefilter=prefilter)


def _outpatient_codes(df: DataFrame) -> DataFrame:
    """ICD_CODE under the name that outpatient results carry."""
    return df.withColumnRenamed("ICD_CODE", "ICDAMB_CODE")


def _dotted_codes(c: Claims) -> DataFrame:
    """Every code of the claims written as code lists write it, with a dot."""
    dotted = F.regexp_replace("ICD_CODE", "^(...)(.+)$", "$1.$2")
    return c.diagnoses.select("ICD_CODE").distinct().select(dotted.alias("LISTED_CODE"))


def _code_list(c: Claims) -> DataFrame:
    """Some of the codes, and two that no diagnosis has; staged, as a list from a file would be."""
    return stage(code_frame(c.vers.sparkSession, LISTED).select("ICD_CODE"), "code-list")


def _prefix_list(c: Claims) -> DataFrame:
    return stage(code_frame(c.vers.sparkSession, PREFIXES).select("ICD_CODE"), "prefix-list")


def _tracer_cohorts(c: Claims) -> DataFrame:
    return op.cohort_for_list(c.diagnoses, _code_list(c))


def _labels(c: Claims) -> DataFrame:
    """Label dimension year, icd_sub, label over the codes in use."""
    text = F.concat(F.lit("Diagnose "), F.col("ICD_CODE"), F.lit(" ("), F.col("BJAHR").cast("string"), F.lit(")"))
    return (
        c.outpatient.select("BJAHR", "ICD_CODE")
        .distinct()
        .select(F.col("BJAHR").alias("year"), F.col("ICD_CODE").alias("icd_sub"), text.alias("label"))
    )


def _diagnosed(c: Claims, code: str, exact: bool = False) -> DataFrame:
    counts = stage(op.diagnosis_counts(op.filter_codes(c.outpatient, code, exact)), "diagnosed")
    return op.diagnosed_persons(counts, c.vers, c.versq, YEAR)


def _scratch(c: Claims, name: str) -> str:
    """A new folder in shared storage."""
    return f"{staging_root(c.vers.sparkSession)}/{name}/{uuid.uuid4().hex}"


def _as_csv(c: Claims, *tables: str) -> str:
    """The claims tables as delimited files, the way they are delivered."""
    folder = _scratch(c, "delivered")
    for table in tables:
        getattr(c, table).write.csv(f"{folder}/{table.upper()}.csv", header=True, nullValue="NA")
    return folder


# --- cohorts ------------------------------------------------------------------------------


@registered
def cohort_exact(c: Claims) -> DataFrame:
    return op.cohort(c.diagnoses, RARE)


@registered
def cohort_prefix(c: Claims) -> DataFrame:
    return op.cohort(c.diagnoses, FAMILY, exact=False)


@registered
def cohort_multi_exact(c: Claims) -> DataFrame:
    return _outpatient_codes(_several(c))


@registered
def cohort_multi_prefix(c: Claims) -> DataFrame:
    return _outpatient_codes(op.cohort(c.outpatient, ("C8", "E84"), exact=False, confirmed_only=False, grain="distinct"))


@registered
def cohort_secondary(c: Claims) -> DataFrame:
    return op.cohort(c.diagnoses, RARE, secondary=True, key=op.CONTRACT)


@registered
def cohort_secondary_relabelled(c: Claims) -> DataFrame:
    return op.cohort(c.diagnoses, RARE, secondary=True, relabel=True, key=op.CONTRACT)


@registered
def cohort_all_years(c: Claims) -> DataFrame:
    return op.cohort(c.diagnoses, RARE, confirmed_only=False, grain="per_source")


@registered
def cohort_by_code_list(c: Claims) -> DataFrame:
    return op.cohort_for_list(c.diagnoses, _code_list(c))


@registered
def cohort_by_prefix_list(c: Claims) -> DataFrame:
    return op.cohort_for_list(c.diagnoses, _prefix_list(c), exact=False)


@registered
def cohort_by_list_secondary(c: Claims) -> DataFrame:
    return op.cohort_for_list(c.diagnoses, _code_list(c), secondary=True, key=op.CONTRACT)


@registered
def unified_diagnoses(c: Claims) -> DataFrame:
    """Both sources in one shape."""
    return c.diagnoses.groupBy("SRC", "ICD_CODE", "SEK_CODE", "DIAGSICH").agg(F.count("*").alias("N_ROWS"))


@registered
def cohort_size(c: Claims) -> DataFrame:
    return op.cohort_size(_several(c))


@registered
def remaining_population(c: Claims) -> DataFrame:
    return op.remaining(c.diagnoses, _cases(c))


@registered
def remaining_population_rows(c: Claims) -> DataFrame:
    return op.remaining(c.diagnoses, _legacy_cases(c), confirmed_only=False, key=op.PERSON, grain="rows")


@registered
def remaining_population_outpatient(c: Claims) -> DataFrame:
    members = stage(_several(c), "several")
    rest = op.remaining(c.outpatient, members, confirmed_only=False, key=op.PERSON, grain="distinct")
    return _outpatient_codes(rest)


# --- demographics -------------------------------------------------------------------------


@registered
def sex_consensus(c: Claims) -> DataFrame:
    return op.sex_by_consensus(c.versq, op.CONTRACT, "Unknown")


@registered
def first_sex_row(c: Claims) -> DataFrame:
    return op.first_sex(c.versq)


@registered
def demographics_rd(c: Claims) -> DataFrame:
    return op.demographics(_cases(c), c.vers, c.versq, op.CASE_RULES, prefilter=True)


@registered
def demographics_remaining(c: Claims) -> DataFrame:
    rest = op.remaining(c.diagnoses, _cases(c))
    return op.demographics(rest, c.vers, c.versq, op.REST_RULES)


@registered
def demographics_fixed_year(c: Claims) -> DataFrame:
    return _fixed_year(c, stage(op.cohort(c.diagnoses, RARE), "rare"), prefilter=True)


@registered
def demographics_m2m(c: Claims) -> DataFrame:
    return _outpatient_codes(op.paired_demographics(stage(_several(c), "several"), c.vers, c.versq, YEAR, prefilter=True))


@registered
def demographics_m2m_remaining(c: Claims) -> DataFrame:
    rest = op.remaining(c.outpatient, stage(_several(c), "several"), confirmed_only=False, key=op.PERSON, grain="distinct")
    return _outpatient_codes(op.paired_demographics(rest, c.vers, c.versq, YEAR))


# --- age and sex --------------------------------------------------------------------------


@registered
def age_sex_case_control(c: Claims) -> DataFrame:
    return op.age_sex_case_control(*_case_control(c), f"!{RARE}")


@registered
def age_sex_case_control_persons(c: Claims) -> DataFrame:
    return op.age_sex_case_control(*_case_control(c), f"!{RARE}", measure="persons")


@registered
def age_sex_by_code(c: Claims) -> DataFrame:
    return op.age_sex_distribution(_fixed_year(c, _tracer_cohorts(c)))


@registered
def age_sex_4band(c: Claims) -> DataFrame:
    return op.age_sex_distribution(_fixed_year(c, _legacy_cases(c), BANDS_FOUR, prefilter=True))


@registered
def age_sex_4band_remaining(c: Claims) -> DataFrame:
    rest = op.remaining(c.diagnoses, _legacy_cases(c), confirmed_only=False, key=op.PERSON, grain="rows")
    return op.age_sex_distribution(_fixed_year(c, rest, BANDS_FOUR))


@registered
def age_sex_8band(c: Claims) -> DataFrame:
    demo = _fixed_year(c, stage(_several(c), "several"), BANDS_EIGHT, prefilter=True)
    return _outpatient_codes(op.age_sex_distribution(demo))


@registered
def age_sex_8band_persons(c: Claims) -> DataFrame:
    # Banded pairs are distinct already: each row is one person.
    demo = op.paired_demographics(
        stage(_several(c), "several"), c.vers, c.versq, YEAR, BANDS_EIGHT, prefilter=True
    )
    return _outpatient_codes(op.age_sex_distribution(demo))


@registered
def age_sex_remaining(c: Claims) -> DataFrame:
    members = stage(_several(c), "several")
    rest = op.remaining(c.outpatient, members, confirmed_only=False, key=op.PERSON, grain="distinct")
    demo = op.paired_demographics(rest, c.vers, c.versq, YEAR, BANDS_EIGHT)
    return _outpatient_codes(op.age_sex_distribution(demo))


# --- postcodes ----------------------------------------------------------------------------


@registered
def plz1_by_code(c: Claims) -> DataFrame:
    return op.plz_distribution(_fixed_year(c, _tracer_cohorts(c)), 1, ("ICD_CODE",))


@registered
def plz2_dist(c: Claims) -> DataFrame:
    return op.plz_distribution(_fixed_year(c, _legacy_cases(c), BANDS_FOUR, prefilter=True), 2, name="PLZ2")


@registered
def plz_case_control(c: Claims) -> DataFrame:
    return op.plz_case_control(*_case_control(c))


@registered
def plz1_case_control(c: Claims) -> DataFrame:
    return op.plz_case_control(*_case_control(c), digits=1)


@registered
def plz_list_by_group(c: Claims) -> DataFrame:
    demo = _fixed_year(c, _legacy_cases(c), BANDS_FOUR, prefilter=True)
    groups = ("ICD_CODE", "BJAHR", "ALTERSGRUPPE", "GESCHLECHT_LABEL")
    return op.plz_list(demo.withColumnRenamed("AGE_GROUP", "ALTERSGRUPPE"), groups)


# --- tracked codes ------------------------------------------------------------------------


def _occurrence_rd(c: Claims, **options) -> DataFrame:
    cases = _cases(c)
    found = op.code_occurrence(c.diagnoses, cases, **options)
    return op.occurrence_age_sex(found, op.profiles(c.vers, c.versq, op.REST_RULES, cases))


@registered
def specific_icd_rd(c: Claims) -> DataFrame:
    return _occurrence_rd(c)


@registered
def specific_icd_rd_legacy(c: Claims) -> DataFrame:
    return _occurrence_rd(c, legacy_precedence=True)


@registered
def specific_icd_any_case_year(c: Claims) -> DataFrame:
    """Tracked codes in every year with the disease, not only the first."""
    every_year = _cases(c, grain="distinct")
    found = op.code_occurrence(c.diagnoses, every_year, link="same_year")
    return op.occurrence_age_sex(found, op.profiles(c.vers, c.versq, op.REST_RULES, every_year))


@registered
def specific_icd_remaining(c: Claims) -> DataFrame:
    found = op.code_occurrence(op.remaining(c.diagnoses, _cases(c)))
    return op.occurrence_age_sex(found, op.profiles(c.vers, c.versq, op.REST_RULES))


def _legacy_occurrence(c: Claims, cases: DataFrame, **options) -> DataFrame:
    return op.code_occurrence(
        c.diagnoses.drop("VSID"),
        cases,
        tracked=TRACKED_CODES_SHORT,
        exact=TRACKED_EXACT_SHORT,
        link="any_year",
        confirmed_only=False,
        **options,
    )


@registered
def specific_icd_all_years(c: Claims) -> DataFrame:
    return _legacy_occurrence(c, _legacy_cases(c), keep_code=True)


@registered
def specific_icd_left(c: Claims) -> DataFrame:
    cases = _legacy_cases(c)
    demo = _fixed_year(c, cases, BANDS_FOUR, prefilter=True)
    return op.occurrence_for_cohort_demographics(_legacy_occurrence(c, cases), demo)


# --- comorbidities ------------------------------------------------------------------------


@registered
def comorbidity_top20(c: Claims) -> DataFrame:
    members = stage(_several(c), "several")
    # One percent: the default of ten leaves nothing on this data.
    return op.comorbidities(c.outpatient, members, SEVERAL, min_share=0.01)


@registered
def comorbidity_top20_by_base_year(c: Claims) -> DataFrame:
    members = stage(_several(c), "several")
    return op.comorbidities(c.outpatient, members, SEVERAL, threshold_scope="base_year")


def _row_counts(c: Claims) -> DataFrame:
    persons = stage(_diagnosed(c, RARE).select("PSID"), "diagnosed-persons")
    return op.comorbidity_row_counts(c.outpatient, persons, RARE)


@registered
def dm_comorbidities(c: Claims) -> DataFrame:
    return _row_counts(c)


@registered
def dm_top20_labelled(c: Claims) -> DataFrame:
    return op.top_labelled(_row_counts(c), _labels(c), LABEL_YEARS)


@registered
def dm_labelled_codes(c: Claims) -> DataFrame:
    return op.labelled_codes(_row_counts(c), _labels(c), LABEL_YEARS)


# --- single-code summaries ----------------------------------------------------------------


@registered
def dm_demographics(c: Claims) -> DataFrame:
    return op.person_demographics(c.vers, c.versq, YEAR)


@registered
def dm_prefix_filter(c: Claims) -> DataFrame:
    return op.filter_codes(c.ambdiag, "E84", column="ICDAMB_CODE")


@registered
def dm_exact_g_filter(c: Claims) -> DataFrame:
    return op.filter_codes(c.ambdiag, FAMILY, exact=True, column="ICDAMB_CODE")


@registered
def dm_age_histogram(c: Claims) -> DataFrame:
    return op.age_histogram(_diagnosed(c, RARE))


@registered
def dm_age_histogram_persons(c: Claims) -> DataFrame:
    return op.age_histogram(_diagnosed(c, RARE), dedupe=True)


@registered
def dm_sex_share(c: Claims) -> DataFrame:
    return op.sex_share(_diagnosed(c, RARE))


@registered
def dm_sex_share_persons(c: Claims) -> DataFrame:
    return op.sex_share(_diagnosed(c, RARE), dedupe=True)


# --- time: spells, states, incidence --------------------------------------------------------


@registered
def insured_spells(c: Claims) -> DataFrame:
    return op.insured_spells(c.versq)


@registered
def insured_spells_with_gaps(c: Claims) -> DataFrame:
    return op.insured_spells(c.versq, op.CONTRACT, max_gap=2)


@registered
def diagnosis_spells(c: Claims) -> DataFrame:
    return op.diagnosis_spells(c.diagnoses, c.versq, max_gap=1)


@registered
def person_quarters(c: Claims) -> DataFrame:
    return op.person_quarters(c.versq)


@registered
def master_as_of(c: Claims) -> DataFrame:
    """What the year before, or the latest one with a master row, said."""
    return op.master_as_of(c.diagnoses, c.vers, allow_equal=False)


@registered
def sex_as_of(c: Claims) -> DataFrame:
    return op.sex_as_of(c.diagnoses, c.versq)


@registered
def sex_as_of_in_bins(c: Claims) -> DataFrame:
    """The same by the form that divides a key by time."""
    return op.sex_as_of(c.diagnoses, c.versq, bin_width=20)


@registered
def case_types(c: Claims) -> DataFrame:
    return op.classify_cases(c.diagnoses, 2)


@registered
def case_types_observed(c: Claims) -> DataFrame:
    return op.classify_cases(c.diagnoses, 1, c.versq)


@registered
def episodes(c: Claims) -> DataFrame:
    return op.episodes(c.diagnoses, 1)


@registered
def incidence(c: Claims) -> DataFrame:
    return op.incidence(op.classify_cases(c.diagnoses, 1, c.versq), c.versq)


# --- publication: hidden counts -----------------------------------------------------------------


@registered
def suppressed_age_sex(c: Claims) -> DataFrame:
    """Age by sex of every code and year, with margins, counts under 5 hidden."""
    return op.suppress(age_sex_8band(c), "ALTERSGRUPPE", "GESCHLECHT_LABEL", ["ICDAMB_CODE", "BJAHR"])


@registered
def suppressed_code_sex(c: Claims) -> DataFrame:
    """One table of all codes and years by sex, counts under 10 hidden."""
    counts = op.totals(age_sex_by_code(c).withColumn("CODE_YEAR", F.concat_ws(" ", "ICD_CODE", "BJAHR")), ["CODE_YEAR", "GESCHLECHT_LABEL"], "N")
    return op.suppress(counts, "CODE_YEAR", "GESCHLECHT_LABEL", value="N", k=10)


# --- margins, sketches, many cohorts, ranks -----------------------------------------------------

DIMS = ("ICD_CODE", "BJAHR", "AGE_GROUP", "GESCHLECHT_LABEL")
FAMILIES = {
    "RARE": TWO, "CYSTIC": FAMILY, "FRACTURE": "S", "TUMOUR": "C", "PRESSURE": ("I10", "I15"), "BONE": "M", "BIRTH": "O8", "INJURY": "T",
}


@registered
def cube_persons(c: Claims) -> DataFrame:
    """Persons of the rest by code, year, age and sex, with all margins."""
    return op.persons_in_sets(demographics_remaining(c), DIMS)


@registered
def rollup_persons(c: Claims) -> DataFrame:
    return op.persons_in_sets(c.diagnoses.filter(op.is_confirmed()), DIMS[:2], [DIMS[:2], DIMS[:1], ()])


def _within_bound(sketches: DataFrame, exact: DataFrame, by: str) -> DataFrame:
    """Exact counts, and whether the sketch is as near as its size promises."""
    about = op.estimated_persons(op.unite_sketches(sketches, [by]))
    near = F.abs(F.col("N_PERSONS_ABOUT") - F.col("N_PERSONS")) <= F.greatest(F.col("N_PERSONS") * F.lit(op.sketch_error()), F.lit(1.0))
    return exact.join(about, by).select(by, "N_PERSONS", near.alias("IN_BOUND"))


@registered
def sketched_persons_by_code(c: Claims) -> DataFrame:
    """Sketches by code and year, stored and then added up over the years."""
    events = c.diagnoses.filter(op.is_confirmed())
    sketches = stage(op.person_sketches(events, ["ICD_CODE", "BJAHR"]), "sketches")
    return _within_bound(sketches, events.groupBy("ICD_CODE").agg(F.count_distinct("PSID").alias("N_PERSONS")), "ICD_CODE")


@registered
def sketched_persons_by_area(c: Claims) -> DataFrame:
    """Sketches by postcode area and birth year, added up over the birth years."""
    homes = op.insured(c.vers).withColumn("AREA", F.substring("PLZ", 1, 1)).filter("AREA <> ''")
    sketches = stage(op.person_sketches(homes, ["AREA", "GEBJAHR"]), "sketches")
    return _within_bound(sketches, homes.groupBy("AREA").agg(F.count_distinct("PSID").alias("N_PERSONS")), "AREA")


@registered
def cohort_membership(c: Claims) -> DataFrame:
    """Persons in exactly which of eight cohorts, all 256 cells."""
    return op.membership_counts(op.membership(c.diagnoses, FAMILIES), FAMILIES)


@registered
def cohort_difference(c: Claims) -> DataFrame:
    """Fractures and high blood pressure, but no tumour."""
    return op.members_of(op.membership(c.diagnoses, FAMILIES), FAMILIES, inside=("FRACTURE", "PRESSURE"), outside=("TUMOUR",))


@registered
def diagnosis_count_tiles(c: Claims) -> DataFrame:
    """Persons in ten tiles by their number of diagnosis rows."""
    counts = c.diagnoses.groupBy("PSID").agg(F.count("*").alias("N_ROWS"))
    return op.tiles(counts, ["N_ROWS", "PSID"], 10)


@registered
def birth_year_quantiles(c: Claims) -> DataFrame:
    return op.quantiles(op.insured(c.vers), "GEBJAHR", ["PSID"], (0.0, 0.1, 0.25, 0.5, 0.9, 1.0))


# --- order in time, arriving files ----------------------------------------------------------------


@registered
def code_sequences(c: Claims) -> DataFrame:
    steps = F.transform("SEQUENCE", lambda x: F.concat_ws(":", x["BJAHR"], x["ICD_CODE"]))
    return op.code_sequences(c.diagnoses).select("PSID", "N_CODES", F.array_join(steps, ">").alias("SEQUENCE"))


@registered
def code_transitions(c: Claims) -> DataFrame:
    return op.transitions(op.code_sequences(c.diagnoses), 2)


@registered
def followed_by(c: Claims) -> DataFrame:
    return op.followed_by(c.diagnoses, FAMILY, "S", 2, exact=False)


@registered
def incremental_cohort(c: Claims) -> DataFrame:
    """First years kept up to date over files that arrive in two runs."""
    spark = c.vers.sparkSession
    folder = _scratch(c, "arriving")
    for run in (0, 1):
        for table in ("ambdiag", "khdiag"):
            getattr(c, table).filter(F.col("BJAHR") % 2 == run).repartition(2).write.mode("append").parquet(f"{folder}/{table.upper()}")
        sources = {t: f"{folder}/{t}" for t in ("AMBDIAG", "KHDIAG")}
        update_first_years(spark, sources, f"{folder}/log", f"{folder}/checkpoint", codes=FAMILY, exact=False, files_per_batch=3)
    return first_years(spark, f"{folder}/log")


# --- code lists, inspection, dictionary ---------------------------------------------------


@registered
def code_list_normalise(c: Claims) -> DataFrame:
    return _dotted_codes(c).select("LISTED_CODE", normalise_code(F.col("LISTED_CODE")).alias("ICD_CODE"))


@registered
def code_list_split(c: Claims) -> DataFrame:
    """Codes in use as outpatient groups or codes, less those that are matched exactly."""
    tracked = c.outpatient.select(F.explode(F.array("ICD_CODE", F.substring("ICD_CODE", 1, 3))).alias("ICD_CODE"))
    exact = c.diagnoses.select("ICD_CODE").filter(F.col("ICD_CODE").isin(*TRACKED_EXACT))
    return op.code_difference(tracked, exact)


@registered
def inspect_top_codes(c: Claims) -> DataFrame:
    return op.top_totals(age_sex_remaining(c), "ICDAMB_CODE")


@registered
def inspect_code_totals(c: Claims) -> DataFrame:
    return op.totals(age_sex_8band(c), ["ICDAMB_CODE"])


@registered
def inspect_sex_totals(c: Claims) -> DataFrame:
    return op.totals(age_sex_8band(c), ["GESCHLECHT_LABEL"])


@registered
def inspect_top_comorbidities(c: Claims) -> DataFrame:
    return op.top_totals(comorbidity_top20(c), "ICDAMB_CODE_COMORBID")


@registered
def result_dictionary(c: Claims) -> DataFrame:
    """Table entries for the codes found in the prefix cohort."""
    return op.table_entries(op.cohort(c.diagnoses, FAMILY, exact=False).select("ICD_CODE"))


# --- files, tables and results: written, then read the way users do -----------------------------


@registered
def delivered_csv_cohort(c: Claims) -> DataFrame:
    """The cohort over four delimited files."""
    given = read_claims(c.vers.sparkSession, _as_csv(c, "ambdiag", "khdiag", "vers", "versq"))
    return op.cohort(given.diagnoses, RARE)


@registered
def delivered_csv_postcodes(c: Claims) -> DataFrame:
    """Postcodes keep their leading zeros, blanks stay blank and missing ones missing."""
    given = read_claims(c.vers.sparkSession, _as_csv(c, "ambdiag", "khdiag", "vers", "versq"))
    return given.vers.groupBy("PLZ").agg(F.count("*").alias("N_ROWS"), F.min("GEBJAHR").alias("GEBJAHR"))


@registered
def delivered_csv_without_inpatients(c: Claims) -> DataFrame:
    """Three files: the absent table is skipped, and the cohort is outpatient."""
    given = read_claims(c.vers.sparkSession, _as_csv(c, "ambdiag", "vers", "versq"))
    return _outpatient_codes(_several(given)) if given.khdiag is None else given.khdiag


@registered
def delivered_code_list(c: Claims) -> DataFrame:
    """A code list with dotted codes, separators and quotes inside fields, and blanks, from a file."""
    spark, path = c.vers.sparkSession, f"{_scratch(c, 'lists')}/codes.csv"
    code = F.col("LISTED_CODE")
    text = F.concat(F.lit('Text; the "one" of '), code)
    rows = _dotted_codes(c).select(code, text.alias("TEXT"), F.length(code).cast("string").alias("ORPHA"), F.lit("x").alias("O"), F.concat(F.lit("  level "), code).alias("LEVEL"))
    rows.coalesce(1).write.csv(path, sep=";", header=True, quote='"', escape='"')
    return read_code_list(spark, path)


@registered
def named_views(c: Claims) -> DataFrame:
    """The claims tables under their own names in SQL."""
    c.register_views()
    return c.vers.sparkSession.sql(
        "SELECT a.DIAGSICH, q.GESCHLECHT, count(*) AS N_ROWS FROM AMBDIAG a JOIN VERSQ q ON a.PSID = q.PSID AND a.VSID = q.VSID GROUP BY ALL"
    )


@registered
def catalogue_tables(c: Claims) -> DataFrame:
    """The cohort over tables of a database."""
    spark, database = c.vers.sparkSession, f"prevalo_claims_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{_scratch(c, 'databases')}'")
    for table in ("ambdiag", "khdiag", "vers", "versq"):
        getattr(c, table).write.saveAsTable(f"{database}.DATRAV_{table.upper()}")
    return op.cohort(read_claims_tables(spark, database).diagnoses, RARE)


@registered
def replaced_result(c: Claims) -> DataFrame:
    """A result that replaces an earlier one of another shape."""
    path = f"{_scratch(c, 'results')}/RT_RESULT"
    write_result(code_list_normalise(c), path)
    write_result(cohort_exact(c), path)
    return c.vers.sparkSession.read.parquet(path)


def _read_in_order(c: Claims, path: str) -> DataFrame:
    """A result that was written as one delimited file, with the number of each line. Quoted blanks are blank, unquoted ones missing."""
    rows = c.vers.sparkSession.read.csv(path, header=True, nullValue="<none>").coalesce(1).withColumn("CNT_D_PSID", F.col("CNT_D_PSID").cast("long"))
    return rows.withColumn("LINE", (F.monotonically_increasing_id() + 1).cast("int"))


@registered
def written_counts_in_order(c: Claims) -> DataFrame:
    """Postcode areas by falling count in the delimited file of a report."""
    root = _scratch(c, "results")
    write_report(fixed_year_report(c, RARE, YEAR), root, single_file=True)
    return _read_in_order(c, f"{root}/RT_RD_PLZ_GROUPED")


@registered
def written_groups_in_order(c: Claims) -> DataFrame:
    """Tracked codes by three ascending keys in the delimited file of a report."""
    root = result_folder(_scratch(c, "results"), RARE, LABEL_YEARS)
    write_report(case_control_report(c, RARE), root, single_file=True)
    return _read_in_order(c, f"{root}/RT_SPECIFIC_ICD_AGE_SEX_DIST")


@registered
def dm_demographics_current_year(c: Claims) -> DataFrame:
    return op.person_demographics(c.vers, c.versq)


@registered
def cohort_lower_case(c: Claims) -> DataFrame:
    """Codes as typed, in lower case and with a dot."""
    return op.cohort(c.diagnoses, normalise_codes(["q78.0", " q78.3"], upper=True))


# --- report tables: each is a table of the whole report, as its caller gets it --------------


def _single(c: Claims) -> dict[str, DataFrame]:
    # The catalogue years that a report accepts start later than the claims.
    labels = _labels(c).withColumn("year", F.col("year") + 20)
    return single_code_report(c, labels, RARE, years=[y + 20 for y in LABEL_YEARS], reference_year=YEAR)


REPORTS: dict[str, Callable[[Claims], dict[str, DataFrame]]] = {
    "tracer": lambda c: tracer_report(c, code_frame(c.vers.sparkSession, LISTED), YEAR),
    "tracer_two_digits": lambda c: tracer_report(c, code_frame(c.vers.sparkSession, LISTED), YEAR, plz_digits=2),
    "case_control": lambda c: case_control_report(c, RARE),
    "case_control_several_codes": lambda c: case_control_report(c, TWO),
    "multi_code": lambda c: multi_code_report(c, SEVERAL, YEAR, min_share=0.01),
    "multi_code_every_row": lambda c: multi_code_report(c, SEVERAL, YEAR, min_share=0.01, every_master_row=True),
    "fixed_year": lambda c: fixed_year_report(c, RARE, YEAR),
    "single_code": _single,
}

# Registered name: the report and the table of it.
REPORT_TABLES = {
    "report_tracer_age_sex": ("tracer", "ALL_age_sex_dist"),
    "report_tracer_plz": ("tracer", "ALL_plz_dist"),
    "report_tracer_plz2": ("tracer_two_digits", "ALL_plz_dist"),
    "report_case_control_age_sex": ("case_control", "RT_RD_NON_RD_AGE_SEX_DIST"),
    "report_case_control_codes": ("case_control", "RT_SPECIFIC_ICD_AGE_SEX_DIST"),
    "report_case_control_codes_rest": ("case_control", "RT_SPECIFIC_ICD_AGE_SEX_DIST_REMAIN"),
    "report_case_control_plz": ("case_control", "RT_PLZ_OI_NON_OI_SEX"),
    "case_control_several_codes": ("case_control_several_codes", "RT_RD_NON_RD_AGE_SEX_DIST"),
    "report_multi_code_age_sex": ("multi_code", "RT_AGE_SEX_DIST"),
    "report_multi_code_comorbidities": ("multi_code", "RT_COMORBIDITIES"),
    "report_multi_code_rest": ("multi_code", "RT_AGE_SEX_DIST_TOT"),
    "report_multi_code_every_row": ("multi_code_every_row", "RT_AGE_SEX_DIST"),
    "report_fixed_year_age_sex": ("fixed_year", "RT_RD_AGE_SEX_DIST"),
    "report_fixed_year_codes": ("fixed_year", "RT_SPECIFIC_ICD_AGE_SEX_DIST"),
    "report_fixed_year_rest": ("fixed_year", "RT_REMAINING_POP_AGE_SEX_DIST"),
    "report_fixed_year_plz": ("fixed_year", "RT_RD_PLZ_GROUPED"),
    "report_single_code_ages": ("single_code", "age_sex_hist"),
    "report_single_code_sexes": ("single_code", "sex_dist"),
    "report_single_code_counts": ("single_code", "top_comorbidities"),
    "report_single_code_top20": ("single_code", "top20_comorbidities"),
    "report_single_code_codes": ("single_code", "top_codes"),
}


def _report_table(report: str, name: str) -> Callable[[Claims], DataFrame]:
    return lambda c: REPORTS[report](c)[name]


REPORT_QUERIES = {name: _report_table(*place) for name, place in REPORT_TABLES.items()}


def registered_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query over the star-schema tables of a folder."""

    def over_star(query: Callable[[Claims], DataFrame]):
        return lambda spark, sf_dir: query(claims_from_star(spark, sf_dir))

    return {name: over_star(query) for name, query in (QUERIES | REPORT_QUERIES).items()}
