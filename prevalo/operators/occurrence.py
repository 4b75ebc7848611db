"""Occurrence of tracked codes, exact or grouped by their first three characters."""

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prevalo.constants import CONFIRMED, INPATIENT, TRACKED_CODES, TRACKED_EXACT
from prevalo.functions import matches_exact, matches_prefix
from prevalo.operators.cohort import for_persons
from prevalo.operators.demographics import REST_RULES, DemographicRules, describe
from prevalo.operators.diagnoses import is_confirmed

GROUP_LENGTH = 3

# How a diagnosis is linked to the cohort row: by person and contract in the cohort's year,
# or in any year.
LINKS = {
    "first_year": ("PSID", "VSID", "BJAHR"),
    "same_year": ("PSID", "VSID", "BJAHR"),
    "any_year": ("PSID",),
}


def prefix_codes(tracked: Iterable[str], exact: Iterable[str]) -> list[str]:
    """Tracked codes that are not matched exactly, in their order."""
    fixed = set(exact)
    return [c for c in dict.fromkeys(tracked) if c not in fixed]


def code_difference(tracked: DataFrame, exact: DataFrame) -> DataFrame:
    """The same for code lists held as tables."""
    return tracked.select("ICD_CODE").distinct().join(exact.select("ICD_CODE"), "ICD_CODE", "left_anti")


def label_occurrences(events: DataFrame, by_exact: Column, by_prefix: Column) -> DataFrame:
    """One row per group a code belongs to: itself when exact, its first characters by prefix.

    Both can hold, so each row gives up to two; a single pass replaces one scan per branch.
    """
    groups = F.array_compact(
        F.array(
            F.when(by_exact, F.col("ICD_CODE")),
            F.when(by_prefix, F.substring("ICD_CODE", 1, GROUP_LENGTH)),
        )
    )
    return events.filter(by_exact | by_prefix).withColumn("ICD_GROUP", F.explode(groups))


def _legacy_prefix_test(prefixes: Sequence[str]) -> Column:
    """Outpatient certainty asked of the last prefix only, as ``a OR b AND c`` binds."""
    code, last = F.col("ICD_CODE"), prefixes[-1]
    sure = (F.col("SRC") == INPATIENT) | (F.col("DIAGSICH") == CONFIRMED)
    tests = [code.startswith(p) for p in prefixes[:-1]] + [code.startswith(last) & sure]
    return reduce(lambda a, b: a | b, tests)


def code_occurrence(
    diagnoses: DataFrame,
    members: DataFrame | None = None,
    *,
    tracked: Iterable[str] = TRACKED_CODES,
    exact: Iterable[str] = TRACKED_EXACT,
    link: str = "first_year",
    confirmed_only: bool = True,
    legacy_precedence: bool = False,
    keep_code: bool = False,
) -> DataFrame:
    """Distinct (person, contract, ICD_GROUP, year) of tracked codes.

    With ``members`` only diagnoses linked to the cohort count: ``first_year`` expects the
    cohort's first years, ``same_year`` a cohort with every year, ``any_year`` needs the
    person only. Without ``members`` every row of ``diagnoses`` counts, as for the
    remaining population, whose table has been reduced and confirmed already.
    """
    exact_list = list(exact)
    prefixes = prefix_codes(tracked, exact_list)
    by_exact = matches_exact(F.col("ICD_CODE"), exact_list)
    by_prefix = matches_prefix(F.col("ICD_CODE"), prefixes)
    if confirmed_only and members is not None:
        by_exact = by_exact & is_confirmed()
        by_prefix = _legacy_prefix_test(prefixes) if legacy_precedence else by_prefix & is_confirmed()
    columns = [c for c in ("PSID", "VSID") if c in diagnoses.columns] + ["ICD_GROUP", "BJAHR"]
    if keep_code:
        columns.append("ICD_CODE")
    found = label_occurrences(diagnoses, by_exact, by_prefix).select(*columns).distinct()
    return found if members is None else for_persons(found, members, LINKS[link]).select(*columns)


def occurrence_age_sex(
    occurrences: DataFrame, profile: DataFrame, rules: DemographicRules = REST_RULES
) -> DataFrame:
    """Person-years per ICD_GROUP, sex and age band at the diagnosis; both must be known."""
    labelled = describe(occurrences, profile, rules)
    known = labelled.filter(F.col("GESCHLECHT_LABEL").isNotNull() & F.col("AGE_GROUP").isNotNull())
    groups = ["ICD_GROUP", "GESCHLECHT_LABEL", "AGE_GROUP"]
    persons = known.select(*groups, "BJAHR", "PSID").distinct()
    return persons.groupBy(*groups).agg(F.count("PSID").alias("CNT_D_PSID"))


def occurrence_for_cohort_demographics(occurrences: DataFrame, demo: DataFrame) -> DataFrame:
    """Persons per ICD_GROUP and year with the sex and age bands of their cohort rows.

    Persons without demographics keep NULL labels. Both sides are distinct first, so a
    person multiplies only by its different labels.
    """
    labels = demo.select("PSID", "GESCHLECHT_LABEL", "AGE_GROUP").distinct()
    events = occurrences.select("PSID", "ICD_GROUP", "BJAHR").distinct()
    groups = ["ICD_GROUP", "BJAHR", "GESCHLECHT_LABEL", "AGE_GROUP"]
    # (person, group, year, labels) is already unique here: a plain count is a distinct count.
    return events.join(labels, "PSID", "left").groupBy(*groups).agg(F.count("PSID").alias("CNT_D_PSID"))
