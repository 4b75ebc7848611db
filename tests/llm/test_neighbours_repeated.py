from prevalo.llm import neighbours
from pyspark.sql import functions as F
from tests.llm.test_neighbours import answers, table


def test_repeated_ids_of_queries_and_candidates(spark):
    """Id 0 on 9 rows among equal vectors and as 9 query rows: 20 other copies, each once."""
    rows = [(0, [1.0, 1.0], "")] * 9 + [(i, [1.0, 1.0], "") for i in range(1, 26)] + [(i, [0.5, 0.1], "") for i in range(50, 60)]
    got = answers(neighbours.search(table(spark, rows), F.col("vec_id") == 0, count=20, visit=1e9, trees=2, depth=2))
    assert got == {0: [(i, 2.0) for i in range(1, 21)]}
