"""Every registered query against its check SQL, and its plan against the ground rules."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from prevalo.catalogue.oracle import check_sql
from prevalo.catalogue.queries import registered_queries
from tests.conftest import rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
QUERIES, CHECKS = registered_queries(), check_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def check_engine():
    engine = duckdb.connect()
    for table in ("lineitem", "orders", "part", "customer"):
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return engine


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_its_check():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_check(spark, check_engine, name):
    df = QUERIES[name](spark, SF_DIR)
    checked = check_engine.execute(CHECKS[name])
    columns = {c[0]: str(c[1]) for c in checked.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == columns

    order = list(columns)
    expected = sorted(checked.fetchall(), key=lambda t: [(v is not None, v) for v in t])
    found = rows(df, *order)
    assert found == expected
    assert found

    plan = plan_of(df)
    for refused in ("CartesianProduct", "NestedLoop", "Python", "Expand"):
        assert refused not in plan, plan


def test_entry_is_the_case_control_table(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["ICD_CODE", "ALTERSGRUPPE", "GESCHLECHT_LABEL", "CNT_D_PSID"]
    assert {"Q780", "!Q780"} <= {r.ICD_CODE for r in df.collect()}
