"""Checked report arguments."""

import datetime
from collections.abc import Iterable

from prevalo.constants import FIRST_LABEL_YEAR


def label_years(years: str | Iterable[int], latest: int | None = None) -> list[int]:
    """Catalogue years from ``"2019,2020"`` or numbers; each must lie in the accepted range."""
    given = years.split(",") if isinstance(years, str) else list(years)
    try:
        listed = [int(y) for y in given]
    except ValueError as error:
        raise ValueError(f"years must be whole numbers separated by commas, got {years!r}") from error
    last = latest or datetime.date.today().year
    refused = [y for y in listed if not FIRST_LABEL_YEAR <= y <= last]
    if refused or not listed:
        raise ValueError(f"years must lie between {FIRST_LABEL_YEAR} and {last}, got {refused or years!r}")
    return listed


def result_folder(root: str, code: str, years: Iterable[int]) -> str:
    """Folder of a single-code report: ``<root>/<code>_<years>_results``."""
    return f"{root}/{code}_{'_'.join(str(y) for y in years)}_results"
