import pytest
from pyspark.sql import functions as F

from prevalo.constants import BANDS_ADULT, BANDS_EIGHT, BANDS_EVENT, BANDS_FOUR, TRACKED_CODES
from prevalo.functions import (
    age_in_year,
    band,
    exact_or_g_suffix,
    histogram_bin,
    matches_exact,
    matches_prefix,
    normalise_code,
    normalise_codes,
    sex_label,
    valid_sex,
)
from tests.conftest import rows


def banded(spark, ages, bands, otherwise=None):
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    return dict(rows(df.select("age", band(F.col("age"), bands, otherwise))))


def test_event_band_edges(spark):
    found = banded(spark, [-1, 0, 18, 19, 49, 50, 120, None], BANDS_EVENT, "Unknown")
    assert found == {
        -1: "Unknown", 0: "0-18", 18: "0-18", 19: "19-49", 49: "19-49", 50: "50+", 120: "50+", None: "Unknown",
    }


def test_band_without_fallback_is_null(spark):
    assert banded(spark, [-1, None], BANDS_EVENT) == {-1: None, None: None}


def test_adult_and_four_band_edges(spark):
    assert banded(spark, [17, 18, 59, 60], BANDS_ADULT) == {17: "0-17", 18: "18-59", 59: "18-59", 60: "60+"}
    assert banded(spark, [19, 20, 39, 40, 59, 60], BANDS_FOUR) == {
        19: "0-19", 20: "20-39", 39: "20-39", 40: "40-59", 59: "40-59", 60: "60+",
    }


def test_first_of_eight_bands_takes_negative_ages(spark):
    assert banded(spark, [-3, 17, 79, 80], BANDS_EIGHT, "Unknown") == {-3: "0-17", 17: "0-17", 79: "70-79", 80: "80+"}


@pytest.mark.parametrize("bands", [BANDS_ADULT, BANDS_EVENT, BANDS_FOUR, BANDS_EIGHT])
def test_every_age_falls_into_the_band_that_names_it(spark, bands):
    for age, label in banded(spark, range(0, 121), bands).items():
        low, _, high = label.rstrip("+").partition("-")
        assert int(low) <= age and (not high or age <= int(high))


def test_age_in_year_defaults_to_the_current_year(spark):
    df = spark.range(1).select(
        age_in_year(2002, F.lit(1950)).alias("fixed"),
        age_in_year(None, F.lit(1950)).alias("now"),
        (F.year(F.current_date()) - 1950).alias("expected"),
    )
    fixed, now, expected = df.first()
    assert fixed == 52 and now == expected


def test_histogram_bins_are_centred_and_closed_on_the_right(spark):
    df = spark.createDataFrame([(a,) for a in (-5, -4, 5, 6, 15, 16, 25)], "age int")
    assert dict(rows(df.select("age", histogram_bin(F.col("age"), 10)))) == {
        -5: -10, -4: 0, 5: 0, 6: 10, 15: 10, 16: 20, 25: 20,
    }


def test_sex_codes(spark):
    df = spark.createDataFrame([(1,), (2,), (0,), (None,)], "s int")
    found = rows(df.select("s", sex_label(F.col("s"), "Unknown"), sex_label(F.col("s")), valid_sex(F.col("s"))))
    assert found == [
        (None, "Unknown", None, None), (0, "Unknown", None, None), (1, "Female", "Female", 1), (2, "Male", "Male", 2),
    ]


def codes_matching(spark, listed, test):
    df = spark.createDataFrame([(c,) for c in listed], "c string")
    return {c for (c,) in df.filter(test(F.col("c"))).collect()}


def test_prefix_has_no_wildcards(spark):
    listed = ["E849", "E84", "EX49", "E%", "E_", "e849", None]
    assert codes_matching(spark, listed, lambda c: matches_prefix(c, ["E84"])) == {"E849", "E84"}
    assert codes_matching(spark, listed, lambda c: matches_prefix(c, ["E_"])) == {"E_"}


def test_long_prefix_lists_match_like_short_ones(spark):
    many = [f"{letter}{n:02d}" for letter in "ABC" for n in range(40)] + ["M796", "X"]
    listed = ["A05", "A051", "B390", "B40", "M7960", "M797", "X1", "A0", None]
    found = codes_matching(spark, listed, lambda c: matches_prefix(c, many))
    assert found == {c for c in listed if c and any(c.startswith(p) for p in many)}


def test_empty_prefix_list_matches_nothing(spark):
    assert codes_matching(spark, ["A"], lambda c: matches_prefix(c, [])) == set()


def test_exact_set_and_g_suffix(spark):
    listed = ["E849", "E849G", "E8490", "XE849", None]
    assert codes_matching(spark, listed, lambda c: matches_exact(c, ["E849", "Q780"])) == {"E849"}
    assert codes_matching(spark, listed, lambda c: exact_or_g_suffix(c, "E849")) == {"E849", "E849G"}


def test_code_normalisation(spark):
    df = spark.createDataFrame([("D59.10",), (" Q78.0 ",), ("B99",)], "c string")
    assert [r[0] for r in df.select(normalise_code(F.col("c"))).collect()] == ["D5910", "Q780", "B99"]
    assert normalise_codes(["C22.2", "C728", "C22.2"]) == ["C222", "C728"]
    assert normalise_codes("e84", upper=True) == ["E84"]
    with pytest.raises(ValueError):
        normalise_codes([])
    with pytest.raises(ValueError):
        normalise_codes(["."])


def test_tracked_codes_have_no_repeats():
    assert len(set(TRACKED_CODES)) == len(TRACKED_CODES) == 23
