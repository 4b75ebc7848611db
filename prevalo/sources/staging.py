"""Staged tables: an intermediate result written once to shared storage and read back."""

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Set to true where file: is a folder that all machines of a cluster mount.
SHARED_FILES = "spark.prevalo.sharedFiles"

#: Bytes that a task reads of a shuffle.
TASK_BYTES = 16 << 20
#: Bytes of files that a task reads.
SPLIT_BYTES = 32 << 20
#: Bytes of stored tables for each shuffle partition. A shuffle holds up to about twice its tables' bytes.
INPUT_BYTES = 4 << 20
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SPLITS = "spark.sql.files.maxPartitionBytes"
PARTITIONS = "spark.sql.shuffle.partitions"

_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def bounded_tasks(spark: SparkSession, *paths: str) -> None:
    """Let AQE merge shuffle partitions up to ``TASK_BYTES`` only and a task read ``SPLIT_BYTES`` of files, unless the session has them lower
    already, and have a shuffle partition for each ``INPUT_BYTES`` of the tables in ``paths``, unless the session has more already.

    Sorts, windows and aggregations hold a task's rows decoded, some ten times what was shuffled, and several of them are
    stacked in one task. Merged up to Spark's 64 MB, tasks grow with the input until they hold gigabytes; merged up to this, more input means
    more tasks of one size. AQE merges partitions but doesn't divide them, so with a fixed number of them each grows with the input all the same.
    What is read from files is sorted by partition before it is shuffled, so it is bounded too.
    """
    for name, most in ((ADVISORY, TASK_BYTES), (SPLITS, SPLIT_BYTES)):
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
            spark.conf.set(name, f"{most}b")
    needed = -(-sum(_stored_bytes(spark, p) for p in paths) // INPUT_BYTES)
    if needed > int(spark.conf.get(PARTITIONS)):
        spark.conf.set(PARTITIONS, needed)


def _stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file, or of all files of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local session without one gets a scratch folder.

    Outside local mode a ``file:`` folder is refused: every machine would have its own.
    """
    local = spark.sparkContext.master.startswith("local")
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not local:
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="prevalo-")
        spark.sparkContext.setCheckpointDir(root)
    if root.startswith("file:") and not local and spark.conf.get(SHARED_FILES, "false") != "true":
        raise RuntimeError(f"spark.checkpoint.dir is {root}: executors can't share it (set {SHARED_FILES} if they do)")
    return root


def _folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/staged/{spark.sparkContext.applicationId}/{_scope.get() or 'session'}"


def _database_name(folder: str) -> str:
    return "prevalo_" + "".join(c if c.isalnum() else "_" for c in folder.rsplit("/staged/", 1)[1]).lower()


def _database(spark: SparkSession, folder: str) -> str:
    """A database that holds the bucketed tables of a folder."""
    name = _database_name(folder)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{folder}'")
    return name


def stage(df: DataFrame, name: str, bucket_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` and read it back.

    Later steps read the small table instead of scanning the claims again, a lost executor
    costs nothing that was staged, and the file size is exact: Catalyst broadcasts the
    table when it is below ``spark.sql.autoBroadcastJoinThreshold`` (and then filters
    before aggregating) and shuffles otherwise. No hint is needed. A large table that
    several joins read by one key is stored in as many buckets as there are shuffle
    partitions, and none of those joins shuffles it again.
    """
    spark = df.sparkSession
    folder, own = _folder(spark), f"{name}-{uuid.uuid4().hex}"
    if bucket_by:
        buckets = int(spark.conf.get(PARTITIONS))
        table = f"{_database(spark, folder)}.`{own}`".replace("-", "_")
        spread = df.repartition(buckets, *bucket_by)
        spread.write.format("parquet").bucketBy(buckets, *bucket_by).sortBy(*bucket_by).saveAsTable(table)
        return spark.table(table)
    path = f"{folder}/{own}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[str]:
    """What is staged inside goes to a folder of its own, which is yielded."""
    token = _scope.set(uuid.uuid4().hex)
    try:
        yield _folder(spark)
    finally:
        _scope.reset(token)


def clear_staged(spark: SparkSession, folder: str | None = None) -> None:
    """Delete a scope's staged tables, or those of the session outside scopes. Results that read them are lost."""
    folder = folder or _folder(spark)
    # Bucketed tables are in a database, which exists only if there are any.
    spark.sql(f"DROP DATABASE IF EXISTS {_database_name(folder)} CASCADE")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
