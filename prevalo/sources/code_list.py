"""Code lists: a delimited file, or codes given by the caller, as a small dimension."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prevalo.functions import normalise_code, normalise_codes
from prevalo.schemas import CODE_LIST_COLUMNS


def read_code_list(spark: SparkSession, path: str, *, sep: str = ";", skip_rows: int = 0) -> DataFrame:
    """Read a delimited code list with a header line; a missing file is an error.

    ``skip_rows`` drops that many lines before the header, for lists that start with
    metadata lines; empty lines don't count. Columns are taken by position, blanks are trimmed,
    dots removed from the codes and lines without a code dropped. Quoted fields may hold the
    separator, quotes and line breaks. A byte-order mark can only sit on a dropped line.
    """
    # One file is read in order by one task; the list is bounded by the code catalogue.
    schema = ", ".join(f"{c} STRING" for c in CODE_LIST_COLUMNS)
    raw = spark.read.schema(schema).csv(path, sep=sep, multiLine=True, quote='"', escape='"')
    numbered = raw.select("*", F.monotonically_increasing_id().alias("at"), F.input_file_name().alias("file"))
    in_file = Window.partitionBy("file").orderBy("at")
    rows = numbered.withColumn("line", F.row_number().over(in_file)).filter(F.col("line") > skip_rows + 1).orderBy("file", "at")
    return (
        rows.select(*(F.trim(c).alias(c) for c in CODE_LIST_COLUMNS))
        .withColumn("ICD_CODE", normalise_code(F.col("ICD_CODE")))
        .filter(F.col("ICD_CODE") != "")
    )


def code_frame(spark: SparkSession, codes: str | Iterable[str]) -> DataFrame:
    """Codes given by the caller as a table; POS keeps their order.

    Exploded from a literal, so that Catalyst knows how small it is.
    """
    return spark.range(1).select(F.posexplode(F.lit(normalise_codes(codes))).alias("POS", "ICD_CODE"))
