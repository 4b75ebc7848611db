"""Age, sex and postcode of cohort members from the insured master tables."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prevalo.constants import BANDS_ADULT, BANDS_EVENT, SEX_LABELS, UNKNOWN
from prevalo.functions import age_at_event, age_in_year, band, consensus_label, first_sex_code, sex_label
from prevalo.functions.bands import Band
from prevalo.operators.cohort import PERSON, CONTRACT, for_persons


@dataclass(frozen=True)
class DemographicRules:
    """How master data becomes one age band and one sex per cohort row.

    ``sex``: ``consensus`` (exactly one known sex among all rows) or ``first_row`` (the
    earliest quarter under a total order). ``reference_year``: None takes the age in the
    diagnosis year, a year takes the age in that year.
    """

    key: Sequence[str] = CONTRACT
    sex: str = "consensus"
    unknown_sex: str | None = None
    known_sex_only: bool = False
    reference_year: int | None = None
    bands: Sequence[Band] = BANDS_EVENT
    unknown_age: str | None = None
    blank_plz_is_missing: bool = False


# Cases keep an 'Unknown' age but need a known sex; the rest leaves both NULL.
CASE_RULES = DemographicRules(unknown_sex=UNKNOWN, known_sex_only=True, unknown_age=UNKNOWN)
REST_RULES = DemographicRules()


def fixed_year_rules(reference_year: int, bands: Sequence[Band] = BANDS_ADULT) -> DemographicRules:
    """Per person, first sex entry, age in a fixed year, 'Unknown' for both when missing."""
    if reference_year is None:
        raise ValueError("a fixed year is needed; DemographicRules(reference_year=None) takes the diagnosis year")
    return DemographicRules(
        key=PERSON,
        sex="first_row",
        unknown_sex=UNKNOWN,
        reference_year=reference_year,
        bands=bands,
        unknown_age=UNKNOWN,
    )


def insured(vers: DataFrame, key: Sequence[str] = PERSON, blank_plz_is_missing: bool = False) -> DataFrame:
    """One row per key: lowest birth year and lowest postcode (text order).

    A blank postcode sorts below every real one unless it is treated as missing.
    """
    plz = F.nullif("PLZ", F.lit("")) if blank_plz_is_missing else F.col("PLZ")
    return vers.groupBy(*key).agg(F.min("GEBJAHR").alias("GEBJAHR"), F.min(plz).alias("PLZ"))


def sex_by_consensus(
    versq: DataFrame, key: Sequence[str] = CONTRACT, otherwise: str | None = None
) -> DataFrame:
    """One row per key with the sex all valid quarterly entries agree on."""
    return versq.groupBy(*key).agg(consensus_label(F.col("GESCHLECHT"), otherwise).alias("GESCHLECHT_LABEL"))


def first_sex(versq: DataFrame, key: Sequence[str] = PERSON) -> DataFrame:
    """One row per key: sex code of the first entry under a total order."""
    return versq.groupBy(*key).agg(first_sex_code().alias("GESCHLECHT"))


def profiles(
    vers: DataFrame, versq: DataFrame, rules: DemographicRules = REST_RULES, persons: DataFrame | None = None
) -> DataFrame:
    """One row per key: GEBJAHR, PLZ and GESCHLECHT_LABEL under the rules.

    ``persons`` restricts both master tables to its keys. When it is a small staged table,
    Catalyst filters the master tables before they are aggregated and shuffled.
    """
    key = list(rules.key)
    master = insured(vers, key, rules.blank_plz_is_missing)
    if rules.sex == "consensus":
        sex, how = sex_by_consensus(versq, key, rules.unknown_sex), "left"
    elif rules.sex == "first_row":
        label = sex_label(first_sex_code(), rules.unknown_sex)
        sex, how = versq.groupBy(*key).agg(label.alias("GESCHLECHT_LABEL")), "inner"
    else:
        raise ValueError(f"unknown sex rule {rules.sex!r}")
    if persons is not None:
        master, sex = for_persons(master, persons, key), for_persons(sex, persons, key)
    return master.join(sex, key, how)


def describe(members: DataFrame, profile: DataFrame, rules: DemographicRules = CASE_RULES) -> DataFrame:
    """Cohort rows with PLZ, ALTER, AGE_GROUP and GESCHLECHT_LABEL from ready profiles."""
    joined = members.join(profile, list(rules.key))
    if rules.known_sex_only:
        joined = joined.filter(F.col("GESCHLECHT_LABEL").isin(*SEX_LABELS.values()))
    birth = F.col("GEBJAHR")
    if rules.reference_year is None:
        age = age_at_event(F.col("BJAHR"), birth)
    else:
        age = age_in_year(rules.reference_year, birth)
    carried = [c for c in members.columns if c != "VSID"]
    return joined.withColumn("ALTER", age).select(
        *carried,
        "PLZ",
        "ALTER",
        band(F.col("ALTER"), rules.bands, rules.unknown_age).alias("AGE_GROUP"),
        "GESCHLECHT_LABEL",
    )


def demographics(
    members: DataFrame,
    vers: DataFrame,
    versq: DataFrame,
    rules: DemographicRules = CASE_RULES,
    *,
    prefilter: bool = False,
) -> DataFrame:
    """Cohort rows with their demographics; ``prefilter`` is for staged cohorts."""
    return describe(members, profiles(vers, versq, rules, members if prefilter else None), rules)


def paired_demographics(
    members: DataFrame,
    vers: DataFrame,
    versq: DataFrame,
    reference_year: int,
    bands: Sequence[Band] | None = None,
    *,
    prefilter: bool = False,
) -> DataFrame:
    """Every known birth year and every known sex of each cohort row.

    All three sides are made distinct before the join, so a person multiplies only by its
    different birth years and sexes and the result needs no second distinct. With
    ``bands`` the birth years are folded into AGE_GROUP before joining, so counting rows
    per group counts distinct persons. ``prefilter`` is for staged cohorts.
    """
    age = age_in_year(reference_year, F.col("GEBJAHR"))
    birth = F.col("GEBJAHR") if bands is None else band(age, bands, UNKNOWN).alias("AGE_GROUP")
    births = vers.filter(F.col("GEBJAHR").isNotNull()).select("PSID", birth).distinct()
    sexes = versq.filter(F.col("GESCHLECHT").isin(*SEX_LABELS)).select("PSID", "GESCHLECHT").distinct()
    if prefilter:
        births, sexes = for_persons(births, members), for_persons(sexes, members)
    columns = ["PSID", "ICD_CODE", "BJAHR"]
    rows = members.select(*columns).distinct().join(births, "PSID").join(sexes, "PSID")
    if bands is None:
        return rows.select(*columns, "GEBJAHR", "GESCHLECHT", age.alias("ALTER"))
    return rows.select(*columns, "AGE_GROUP", sex_label(F.col("GESCHLECHT")).alias("GESCHLECHT_LABEL"))


def person_demographics(
    vers: DataFrame, versq: DataFrame, reference_year: int | None = None, persons: DataFrame | None = None
) -> DataFrame:
    """One row per person present in both master tables, first entry of each by a total order.

    The least pair of a cross product is the pair of the least entries, so each table is
    reduced on its own before they meet. ``persons`` restricts both tables to its keys.
    """
    master = vers.groupBy("PSID").agg(F.min(F.struct("VSID", "GEBJAHR", "PLZ")).alias("v"))
    quarter = versq.groupBy("PSID").agg(F.min(F.struct("VERSQ", "VSID", "GESCHLECHT")).alias("q"))
    if persons is not None:
        master, quarter = for_persons(master, persons), for_persons(quarter, persons)
    return master.join(quarter, "PSID").select(
        "PSID",
        F.col("v.VSID").alias("VSID_X"),
        F.col("v.GEBJAHR").alias("GEBJAHR"),
        F.col("v.PLZ").alias("PLZ"),
        F.col("q.VSID").alias("VSID_Y"),
        F.col("q.VERSQ").alias("VERSQ"),
        sex_label(F.col("q.GESCHLECHT")).alias("GESCHLECHT"),
        age_in_year(reference_year, F.col("v.GEBJAHR")).alias("ALTER"),
    )
