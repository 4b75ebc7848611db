"""Pure ``Column`` builders shared by the operators."""

from prevalo.functions.bands import age_at_event, age_in_year, band, histogram_bin
from prevalo.functions.codes import (
    exact_or_g_suffix,
    match_codes,
    matches_exact,
    matches_prefix,
    normalise_code,
    normalise_codes,
)
from prevalo.functions.sex import consensus_label, first_sex_code, sex_label, valid_sex

__all__ = [
    "age_at_event",
    "age_in_year",
    "band",
    "consensus_label",
    "exact_or_g_suffix",
    "first_sex_code",
    "histogram_bin",
    "match_codes",
    "matches_exact",
    "matches_prefix",
    "normalise_code",
    "normalise_codes",
    "sex_label",
    "valid_sex",
]
