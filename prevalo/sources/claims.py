"""The four claims tables: outpatient and inpatient diagnoses, insured and quarterly masters."""

import warnings
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prevalo.operators.diagnoses import unified_diagnoses
from prevalo.schemas import OPTIONAL_COLUMNS, claims_schemas


@dataclass(frozen=True)
class Claims:
    """Claims tables as DataFrames, wherever they come from. Missing tables are None."""

    ambdiag: DataFrame | None
    vers: DataFrame | None
    versq: DataFrame | None
    khdiag: DataFrame | None = None

    @cached_property
    def diagnoses(self) -> DataFrame:
        """Outpatient and inpatient diagnoses in one shape."""
        return unified_diagnoses(self.ambdiag, self.khdiag)

    @cached_property
    def outpatient(self) -> DataFrame:
        return unified_diagnoses(self.ambdiag)

    def register_views(self) -> None:
        """Expose the tables to ``spark.sql`` under their own names."""
        for name in ("ambdiag", "khdiag", "vers", "versq"):
            table = getattr(self, name)
            if table is not None:
                table.createOrReplaceTempView(name.upper())


def _conform(raw: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """The needed columns, and the optional ones that are there, by name and type, whatever else the table holds."""
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    more = {name: kind for name, kind in OPTIONAL_COLUMNS.get(table, {}).items() if name in raw.columns}
    kinds = {f.name: f.dataType for f in schema} | more
    return raw.select(*(F.col(name).cast(kind).alias(name) for name, kind in kinds.items()))


def _assemble(tables: dict[str, DataFrame]) -> Claims:
    return Claims(**{name: tables.get(name.upper()) for name in ("ambdiag", "khdiag", "vers", "versq")})


def read_claims(
    spark: SparkSession,
    root: str,
    fmt: str = "csv",
    *,
    optional: Iterable[str] = ("KHDIAG",),
    id_type: T.DataType | None = None,
    sep: str = ",",
) -> Claims:
    """Read ``<root>/<TABLE>.<fmt>`` for each claims table.

    CSV columns are taken by header name and typed explicitly, so postcodes keep their
    leading zeros. A table in ``optional`` that cannot be found becomes a warning and
    None; any other absence is an error.
    """
    allowed, tables = {t.upper() for t in optional}, {}
    for table, schema in claims_schemas(id_type).items():
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.options(header=True, sep=sep, nullValue="NA", inferSchema=False)
        try:
            raw = reader.load(f"{root}/{table}.{fmt}")
        except AnalysisException as error:
            if table not in allowed or "PATH_NOT_FOUND" not in str(error):
                raise
            warnings.warn(f"{table}: not found under {root}, table skipped", stacklevel=2)
            continue
        tables[table] = _conform(raw, schema, table)
    return _assemble(tables)


def read_claims_tables(
    spark: SparkSession,
    database: str,
    prefix: str = "DATRAV_",
    *,
    tables: Iterable[str] = ("AMBDIAG", "KHDIAG", "VERS", "VERSQ"),
    id_type: T.DataType | None = None,
) -> Claims:
    """Read catalogue tables named ``<database>.<prefix><TABLE>``."""
    schemas = claims_schemas(id_type)
    return _assemble(
        {t: _conform(spark.table(f"{database}.{prefix}{t}"), schemas[t], t) for t in tables}
    )


# Diagnosis files are ordered by code, so a cohort's scan skips the blocks of other codes.
STORED_ORDER = {"ambdiag": ["ICDAMB_CODE"], "khdiag": ["ICDKH_CODE"], "vers": ["PSID"], "versq": ["PSID"]}


def store_claims(claims: Claims, root: str, *, database: str | None = None, buckets: int = 0) -> Claims:
    """Write the tables as ``<root>/<TABLE>.parquet`` and return them read from there.

    Worth doing once for delimited sources, which every report would parse again. Rows are
    ordered within each file only, which needs no shuffle. With ``buckets`` the two master
    tables become tables of ``database`` that are bucketed by person and contract (one shuffle
    now); reports that read them by that key never shuffle them again.
    """
    tables = {}
    for name, order in STORED_ORDER.items():
        table = getattr(claims, name)
        if table is None:
            continue
        path, spark = f"{root}/{name.upper()}.parquet", table.sparkSession
        if buckets and name in ("vers", "versq"):
            if database is None:
                raise ValueError("bucketed tables need a database")
            spread = table.repartition(buckets, "PSID", "VSID").write.format("parquet").mode("overwrite")
            spread.bucketBy(buckets, "PSID", "VSID").sortBy("PSID", "VSID").option("path", path).saveAsTable(f"{database}.{name.upper()}")
            tables[name.upper()] = spark.table(f"{database}.{name.upper()}")
        else:
            table.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
            tables[name.upper()] = spark.read.schema(table.schema).parquet(path)
    return _assemble(tables)
