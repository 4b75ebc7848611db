"""Cohort operators: DataFrame in, DataFrame out."""

from prevalo.operators.asof import as_of, master_as_of, sex_as_of
from prevalo.operators.cohort import (
    CONTRACT,
    PERSON,
    cohort,
    cohort_for_list,
    cohort_size,
    contract_years,
    for_persons,
    remaining,
)
from prevalo.operators.comorbidity import (
    comorbidities,
    comorbidity_row_counts,
    labelled_codes,
    top_labelled,
)
from prevalo.operators.demographics import (
    CASE_RULES,
    REST_RULES,
    DemographicRules,
    demographics,
    describe,
    first_sex,
    fixed_year_rules,
    insured,
    paired_demographics,
    person_demographics,
    profiles,
    sex_by_consensus,
)
from prevalo.operators.diagnoses import (
    filter_codes,
    is_confirmed,
    unified_diagnoses,
)
from prevalo.operators.dictionary import column_entries, table_entries
from prevalo.operators.disclosure import suppress, suppress_report, with_margins
from prevalo.operators.distributions import (
    age_sex_case_control,
    age_sex_distribution,
    top_totals,
    totals,
)
from prevalo.operators.geography import plz_case_control, plz_distribution, plz_list
from prevalo.operators.incidence import classify_cases, episodes, incidence
from prevalo.operators.intervals import diagnosis_spells, insured_spells, interval_join, person_quarters
from prevalo.operators.margins import estimated_persons, person_sketches, persons_in_sets, sketch_error, unite_sketches
from prevalo.operators.membership import members_of, membership, membership_counts
from prevalo.operators.occurrence import (
    code_difference,
    code_occurrence,
    label_occurrences,
    occurrence_age_sex,
    occurrence_for_cohort_demographics,
    prefix_codes,
)
from prevalo.operators.ranks import quantiles, ranked, tiles
from prevalo.operators.sequences import code_sequences, followed_by, transitions
from prevalo.operators.summaries import age_histogram, diagnosed_persons, diagnosis_counts, sex_share

__all__ = [
    "CASE_RULES",
    "CONTRACT",
    "DemographicRules",
    "PERSON",
    "REST_RULES",
    "age_histogram",
    "age_sex_case_control",
    "age_sex_distribution",
    "as_of",
    "classify_cases",
    "code_difference",
    "code_occurrence",
    "code_sequences",
    "cohort",
    "cohort_for_list",
    "cohort_size",
    "column_entries",
    "comorbidities",
    "comorbidity_row_counts",
    "contract_years",
    "demographics",
    "describe",
    "diagnosed_persons",
    "diagnosis_counts",
    "diagnosis_spells",
    "episodes",
    "estimated_persons",
    "filter_codes",
    "first_sex",
    "fixed_year_rules",
    "followed_by",
    "for_persons",
    "incidence",
    "insured",
    "insured_spells",
    "interval_join",
    "is_confirmed",
    "label_occurrences",
    "labelled_codes",
    "master_as_of",
    "members_of",
    "membership",
    "membership_counts",
    "occurrence_age_sex",
    "occurrence_for_cohort_demographics",
    "paired_demographics",
    "person_demographics",
    "person_quarters",
    "person_sketches",
    "persons_in_sets",
    "plz_case_control",
    "plz_distribution",
    "plz_list",
    "prefix_codes",
    "profiles",
    "quantiles",
    "ranked",
    "remaining",
    "sex_as_of",
    "sex_by_consensus",
    "sex_share",
    "sketch_error",
    "suppress",
    "suppress_report",
    "table_entries",
    "tiles",
    "top_labelled",
    "top_totals",
    "totals",
    "transitions",
    "unified_diagnoses",
    "unite_sketches",
    "with_margins",
]
