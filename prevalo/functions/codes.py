"""Diagnosis-code normalisation and matching."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_code(code: Column) -> Column:
    """Code without surrounding blanks and dots: ``D59.10`` becomes ``D5910``."""
    return F.trim(F.translate(code, ".", ""))


def normalise_codes(codes: str | Iterable[str], upper: bool = False) -> list[str]:
    """The same for codes given by the caller; order is kept, repeats are dropped."""
    given = [codes] if isinstance(codes, str) else list(codes)
    cleaned = [c.replace(".", "").strip() for c in given]
    if not cleaned or not all(cleaned):
        raise ValueError(f"at least one non-empty diagnosis code is needed, got {given!r}")
    return list(dict.fromkeys(c.upper() if upper else c for c in cleaned))


def matches_exact(code: Column, codes: Iterable[str]) -> Column:
    return code.isin(*codes)


def matches_prefix(code: Column, prefixes: Iterable[str]) -> Column:
    """True when ``code`` starts with any prefix; ``%`` and ``_`` have no special meaning.

    Always StartsWith tests, which Parquet can push down. Lists of codes that come from a
    file belong in a table: ``cohort_for_list`` joins them.
    """
    tests = [code.startswith(p) for p in prefixes]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def match_codes(code: Column, codes: Iterable[str], exact: bool) -> Column:
    return matches_exact(code, codes) if exact else matches_prefix(code, codes)


def exact_or_g_suffix(code: Column, wanted: str) -> Column:
    """The code itself or the code with a trailing ``G``."""
    return code.isin(wanted, wanted + "G")
