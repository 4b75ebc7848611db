"""Ages and age bands."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Band = tuple[int | None, int | None, str]


def age_in_year(year: int | Column | None, birth_year: Column) -> Column:
    """Age reached in ``year``; the current calendar year when ``year`` is None."""
    anchor = F.year(F.current_date()) if year is None else year
    return (F.lit(anchor) - birth_year).cast("int")


def age_at_event(event_year: Column, birth_year: Column) -> Column:
    return (event_year - birth_year).cast("int")


def band(age: Column, bands: Iterable[Band], otherwise: str | None = None) -> Column:
    """Label of the band that holds ``age``; NULL and uncovered ages get ``otherwise``."""
    result = None
    for low, high, label in bands:
        bounds = [age >= low] if low is not None else []
        bounds += [age <= high] if high is not None else []
        inside = reduce(lambda a, b: a & b, bounds)
        result = F.when(inside, label) if result is None else result.when(inside, label)
    return result.otherwise(F.lit(otherwise).cast("string"))


def histogram_bin(value: Column, width: int) -> Column:
    """Centre of the histogram bin: centred on multiples of ``width``, closed on the right."""
    return (F.ceil((value - width / 2) / width) * width).cast("int")
