"""First-year cohorts from claims files that keep arriving.

A run takes the files that no run before has seen, adds them to the state (a first year for each person and
code) and appends the first years that it touched to a log. The log's minimum is the cohort. Files, state
and log positions are kept in the checkpoint folder, so a run that was stopped is taken up where it was, and nothing
counts twice: a batch that is repeated overwrites its own part of the log.
"""

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prevalo.functions import match_codes, normalise_codes
from prevalo.operators.cohort import PERSON, _reduce
from prevalo.operators.diagnoses import is_confirmed, unified_diagnoses
from prevalo.schemas import claims_schemas


def update_first_years(
    spark: SparkSession,
    sources: dict[str, str],
    log: str,
    checkpoint: str,
    *,
    codes: str | Iterable[str] | None = None,
    exact: bool = True,
    confirmed_only: bool = True,
    key: Sequence[str] = PERSON,
    files_per_batch: int = 1000,
) -> int:
    """Add all new parquet files of ``sources`` (AMBDIAG and, optionally, KHDIAG: a folder each) to the log; the number of batches.

    The aggregation is Spark's own: rows are combined map-side, and state is divided by key among the shuffle partitions that the
    first run fixes. ``spark.sql.streaming.stateStore.providerClass`` selects RocksDB for state beyond memory.
    """
    schemas = claims_schemas()

    def arriving(table: str) -> DataFrame | None:
        if table not in sources:
            return None
        return spark.readStream.schema(schemas[table]).option("maxFilesPerTrigger", files_per_batch).parquet(sources[table])

    events = unified_diagnoses(arriving("AMBDIAG"), arriving("KHDIAG"))
    events = events.filter(is_confirmed()) if confirmed_only else events
    if codes is not None:
        events = events.filter(match_codes(F.col("ICD_CODE"), normalise_codes(codes), exact))
    batches: list[int] = []

    def append(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{log}/batch={number}")
        batches.append(number)

    query = _reduce(events, key, "first_year").writeStream.outputMode("update").foreachBatch(append)
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(batches)


def first_years(spark: SparkSession, *logs: str, key: Sequence[str] = PERSON) -> DataFrame:
    """The cohort of one or several logs: ``key``, ICD_CODE, BJAHR."""
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(log).select(*key, "ICD_CODE", "BJAHR") for log in logs])
    return _reduce(rows, key, "first_year")


def compact_first_years(spark: SparkSession, log: str, target: str, key: Sequence[str] = PERSON) -> None:
    """Write a log's cohort as one table, which can stand for the log's batches so far."""
    first_years(spark, log, key=key).write.mode("overwrite").parquet(target)
