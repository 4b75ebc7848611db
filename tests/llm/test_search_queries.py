import duckdb
from prevalo.llm.search_queries import SEARCH_QUERIES, SEARCH_SQL


def same_as_duckdb(spark, folder, name):
    """The query's rows and those of its check SQL are the same, column by column."""
    got = SEARCH_QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(SEARCH_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    rows = sorted(want.project(", ".join(order)).fetchall(), key=str)
    assert sorted((tuple(r) for r in got.select(*order).collect()), key=str) == rows and rows


def test_every_sql_has_its_query():
    assert set(SEARCH_QUERIES) == set(SEARCH_SQL)
