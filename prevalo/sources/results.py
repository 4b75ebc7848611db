"""Result sinks."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame


def write_result(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    *,
    order_by: Iterable[str | Column] = (),
    single_file: bool = False,
) -> None:
    """Replace ``path`` with the result. CSV files carry a header.

    ``single_file`` is for tables that are known to be small. The sort happens here, since
    a stored table keeps no order of its own.
    """
    ordering = list(order_by)
    result = df.orderBy(*ordering) if ordering else df
    if single_file:
        result = result.coalesce(1)
    writer = result.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
