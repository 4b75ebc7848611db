import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from prevalo.sources import Claims  # noqa: E402

AMB = "PSID long, VSID long, BJAHR int, ICDAMB_CODE string, DIAGSICH string"
KH = "PSID long, VSID long, BJAHR int, ICDKH_CODE string, SEKICD_CODE string"
VERS = "PSID long, VSID long, GEBJAHR int, PLZ string"
VERSQ = "PSID long, VSID long, VERSQ int, GESCHLECHT int"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def claims(spark):
    """Builds claims from hand-written rows."""

    def build(amb=(), kh=(), vers=(), versq=()) -> Claims:
        return Claims(
            ambdiag=spark.createDataFrame(list(amb), AMB),
            khdiag=spark.createDataFrame(list(kh), KH),
            vers=spark.createDataFrame(list(vers), VERS),
            versq=spark.createDataFrame(list(versq), VERSQ),
        )

    return build


def rows(df, *columns):
    """Sorted tuples of the given columns, NULL first."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: [(v is not None, v) for v in t])
