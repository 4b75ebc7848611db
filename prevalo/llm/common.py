"""Helpers shared by the operators: table reading, staging, batch limits, stable random numbers."""

from __future__ import annotations

import contextlib
import ctypes
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prevalo.sources.staging import stage

__all__ = ["WORD", "give_back", "python_workers", "stage", "table", "uniform", "word_count"]

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of the rows that one Arrow batch may hold; a batch of long texts is cut, a single row never.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_workers(spark: SparkSession) -> None:
    """Settings for operators with Python code: Arrow batches that are small in bytes, however long the
    texts are, and a module path on which local workers find this package wherever the driver was started."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [root, environment.get("PYTHONPATH", "")]))


def give_back() -> None:
    """Return what a Python worker has freed to the machine: Arrow's pool and the allocator keep it otherwise,
    and workers live on between the tasks of all operators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) fixed by the parts: 52 bits of an MD5 digest, plus a half step."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
