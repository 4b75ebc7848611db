"""Insured spells, and joins of intervals."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prevalo.operators.cohort import PERSON, _reduce
from prevalo.operators.diagnoses import is_confirmed
from prevalo.sources.staging import stage

#: Rows of one key beyond which an interval join divides them.
HOT_ROWS = 1 << 20


def quarter_number(quarter: Column) -> Column:
    """Quarters since year 0 of a quarter id (year * 10 + 1 to 4); NULL for any other id."""
    return F.when((quarter % 10).between(1, 4), (F.floor(quarter / 10) * 4 + quarter % 10 - 1).cast("int"))


def quarter_id(number: Column) -> Column:
    """The quarter id of a quarter's number."""
    return (F.floor(number / 4) * 10 + number % 4 + 1).cast("int")


def insured_spells(versq: DataFrame, key: Sequence[str] = PERSON, max_gap: int = 0) -> DataFrame:
    """Maximal runs of insured quarters per key: SPELL (1, 2, ...), SPELL_START, SPELL_END and N_QUARTERS.

    ``max_gap`` missing quarters don't end a spell and aren't counted. Quarters are made distinct first,
    map-side, so a key reaches its window with no more rows than there are quarters. Rows without a valid
    quarter say nothing.
    """
    if max_gap < 0:
        raise ValueError("a gap can't be negative")
    quarters = versq.select(*key, quarter_number(F.col("VERSQ")).alias("Q")).filter("Q IS NOT NULL").distinct()
    order = Window.partitionBy(*key).orderBy("Q")
    goes_on = F.col("Q") - F.lag("Q").over(order) <= max_gap + 1
    numbered = quarters.withColumn("FRESH", F.when(goes_on, 0).otherwise(1))
    numbered = numbered.withColumn("SPELL", F.sum("FRESH").over(order).cast("int"))
    spells = numbered.groupBy(*key, "SPELL").agg(F.min("Q").alias("FIRST"), F.max("Q").alias("LAST"), F.count("*").alias("N_QUARTERS"))
    return spells.select(*key, "SPELL", quarter_id(F.col("FIRST")).alias("SPELL_START"), quarter_id(F.col("LAST")).alias("SPELL_END"), "N_QUARTERS")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Pairs of equal keys whose closed intervals of whole numbers overlap.

    Intervals are laid over bins of ``width`` numbers, and rows meet by key and bin: an equality join, which
    no interval makes larger than the bins it covers. A pair that shares several bins is kept in the first of
    them only, so nothing has to be made distinct afterwards.

    Keys with more than ``hot_rows`` rows on the left are divided by a hash of the whole row, and the right
    rows of those keys alone are sent to each part. Equal rows of one key stay together: give them
    reduced, with a count. Rows with a NULL key or bound, or a start behind its end, overlap nothing. The two sides must not
    share columns other than ``on``.
    """
    if width < 1:
        raise ValueError("bins need a width")
    shared = (set(left.columns) & set(right.columns)) - set(on)
    if shared:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    known = [F.col(k).isNotNull() for k in on]

    def valid(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        return df.filter(F.col(span[0]) <= F.col(span[1])).filter(_all(known))

    def first_bin(span: tuple[str, str]) -> Column:
        return F.floor(F.col(span[0]) / width)

    left, right = valid(left, left_span), valid(right, right_span)
    columns = [*left.columns, *[c for c in right.columns if c not in on]]
    often = left.groupBy(*on).agg(F.count("*").alias("__N")).filter(F.col("__N") > hot_rows)
    often = stage(often.select(*on, F.ceil(F.col("__N") / hot_rows).cast("int").alias("__PARTS")), "hot-keys")
    parts = F.coalesce("__PARTS", F.lit(1))
    own = F.pmod(F.xxhash64(*left.columns), parts).cast("int")
    left = left.join(often, list(on), "left").withColumn("__PART", own).drop("__PARTS")
    right = right.join(often, list(on), "left").withColumn("__PART", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__PARTS")

    def binned(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        return df.withColumn("__BIN", F.explode(F.sequence(first_bin(span), F.floor(F.col(span[1]) / width))))

    joined = binned(left, left_span).join(binned(right, right_span), [*on, "__PART", "__BIN"])
    overlap = (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1]))
    first = F.col("__BIN") == F.greatest(first_bin(left_span), first_bin(right_span))
    return joined.filter(overlap & first).select(*columns)


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def diagnosis_spells(
    diagnoses: DataFrame,
    versq: DataFrame,
    key: Sequence[str] = PERSON,
    *,
    confirmed_only: bool = True,
    max_gap: int = 0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Diagnoses with the insured spells that touch their year: N_ROWS diagnosis rows, the spell, and QUARTERS_IN_YEAR of it.

    Diagnoses are reduced per key, code and year before they meet the spells. One that lies in a year
    without any insured quarter has no row.
    """
    events = diagnoses.filter(is_confirmed()) if confirmed_only else diagnoses
    reduced = _reduce(events, key, "rows").withColumns({"FROM_Q": F.col("BJAHR") * 4, "TO_Q": F.col("BJAHR") * 4 + 3})
    spells = insured_spells(versq, key, max_gap)
    spells = spells.withColumns({"START_Q": quarter_number(F.col("SPELL_START")), "END_Q": quarter_number(F.col("SPELL_END"))})
    met = interval_join(reduced, spells, key, ("FROM_Q", "TO_Q"), ("START_Q", "END_Q"), 8, hot_rows)
    covered = F.least("TO_Q", "END_Q") - F.greatest("FROM_Q", "START_Q") + 1
    return met.select(*key, "ICD_CODE", "BJAHR", "N_ROWS", "SPELL", "SPELL_START", "SPELL_END", covered.alias("QUARTERS_IN_YEAR"))


def person_quarters(versq: DataFrame) -> DataFrame:
    """Insured persons and person-quarters per year: BJAHR, N_PERSONS, PERSON_QUARTERS."""
    quarters = versq.select("PSID", quarter_number(F.col("VERSQ")).alias("Q")).filter("Q IS NOT NULL AND PSID IS NOT NULL").distinct()
    per_person = quarters.groupBy("PSID", F.floor(F.col("Q") / 4).cast("int").alias("BJAHR")).agg(F.count("*").alias("N"))
    return per_person.groupBy("BJAHR").agg(F.count("*").alias("N_PERSONS"), F.sum("N").alias("PERSON_QUARTERS"))
