"""Sex codes, labels and the consensus rule."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from prevalo.constants import SEX_LABELS


def valid_sex(code: Column) -> Column:
    """The code itself when it is a known sex, else NULL."""
    return F.when(code.isin(*SEX_LABELS), code)


def sex_label(code: Column, otherwise: str | None = None) -> Column:
    result = None
    for value, label in SEX_LABELS.items():
        result = F.when(code == value, label) if result is None else result.when(code == value, label)
    return result.otherwise(F.lit(otherwise).cast("string"))


def consensus_label(code: Column, otherwise: str | None = None) -> Column:
    """Aggregate: the label when a group holds exactly one known sex, else ``otherwise``.

    One distinct value means minimum = maximum, which needs no distinct aggregation.
    """
    lowest, highest = F.min(valid_sex(code)), F.max(valid_sex(code))
    return sex_label(F.when(lowest == highest, lowest), otherwise)


def first_sex_code() -> Column:
    """Aggregate: sex code of the first quarterly entry by quarter, contract and code.

    A minimum over the ordering columns picks the row in one combining aggregation, so no
    key's rows are gathered and sorted in a window.
    """
    return F.min(F.struct("VERSQ", "VSID", "GESCHLECHT")).getField("GESCHLECHT")
