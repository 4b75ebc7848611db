import numpy as np
import pytest
from pyspark.sql import functions as F

from prevalo.llm import neighbours
from prevalo.llm.queries import op2_neighbours


def exact(ids, vectors, queries, count):
    out = {}
    for q in queries:
        scores = [((vectors[i] * vectors[q]).sum(), ids[i]) for i in range(len(ids)) if ids[i] != ids[q]]
        out[ids[q]] = [(v, s) for s, v in sorted(scores, key=lambda x: (-x[0], x[1]))[:count]]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_on_the_test_table(spark, text_dir):
    rows = spark.read.parquet(f"{text_dir}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, vectors = rows["vec_id"].tolist(), np.array(rows["embedding"].tolist(), np.float64)
    want = exact(ids, vectors, [i for i, v in enumerate(ids) if v % 20 == 0], 20)
    got = answers(op2_neighbours(spark, text_dir))
    assert {k: len(v) for k, v in got.items()} == {k: 20 for k in want}
    hits = sum(len({v for v, _ in got[k]} & {v for v, _ in want[k]}) for k in want)
    assert hits >= 0.9 * 20 * len(want)
    scores = {k: dict(v) for k, v in want.items()}
    assert all(s == scores[k][v] for k in got for v, s in got[k] if v in scores[k])


def test_all_leaves_visited_is_exact_with_ties_copies_and_unequal_norms(spark):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-3, 4, (150, 4)).astype(np.float32) * rng.integers(1, 5, (150, 1)).astype(np.float32)
    vectors[vectors.any(axis=1) == 0] = 1
    vectors[60:130] = vectors[60]
    ids = list(range(150))
    odd = [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 1.0]), (204, [float("nan")] * 4), (205, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (206, [1.0, 2.0])]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)] + [(i, v, None) for i, v in odd]
    got = answers(neighbours.search(table(spark, rows), F.col("vec_id") % 10 == 0, count=20, visit=1e9, trees=2, depth=3, block=40))
    assert got == exact(ids, vectors.astype(np.float64), range(0, 150, 10), 20)


def test_fewer_candidates_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0], ""), (1, [0.5, 0.5], "")]
    got = answers(neighbours.search(table(spark, rows), F.col("vec_id") == 0, visit=9.0, trees=2, depth=2))
    assert got == {0: [(1, 0.5)]}
    assert neighbours.search(table(spark, []), F.col("vec_id") == 0).count() == 0
    assert neighbours.search(table(spark, rows), F.col("vec_id") == 5).count() == 0


def test_leaves_partition_the_sample():
    rng = np.random.default_rng(2)
    sample = rng.standard_normal((300, 6))
    forest = neighbours.fit_forest(sample, float(np.linalg.norm(sample, axis=1).max()), trees=3, depth=4)
    leaf = forest.leaves(forest.lifted(sample))
    for t in range(3):
        assert np.allclose(np.bincount(leaf[t], minlength=16) / 300, forest.share[t], atol=2 / 300)
    # A query's best leaf of a tree is the one that it lies in itself.
    unit = sample / np.linalg.norm(sample, axis=1)[:, None]
    own = forest.leaves(np.concatenate([unit, np.zeros((300, 1))], axis=1))
    assert (forest.priorities(sample).argmax(axis=2).T == own).mean() > 0.98


@pytest.mark.parametrize("n", [1, 2, 6, 16, 41, 101])
def test_small_tables_are_exact_with_default_parameters(spark, n):
    rng = np.random.default_rng(n)
    vectors = rng.standard_normal((n, 16)).astype(np.float32)
    rows = [(i, v.tolist(), "") for i, v in enumerate(vectors)]
    got = answers(neighbours.search(table(spark, rows), F.col("vec_id") % 20 == 0))
    want = exact(list(range(n)), vectors.astype(np.float64), range(0, n, 20), 20)
    assert got == {k: v for k, v in want.items() if v} and all(len(v) == min(20, n - 1) for v in got.values())


@pytest.mark.parametrize("count", [1, 20])
def test_wide_ties_go_to_the_smallest_ids(spark, count):
    """0/1 vectors: hundreds of rows have the score of the last neighbour."""
    vectors = np.random.default_rng(3).integers(0, 2, (600, 16)).astype(np.float32)
    vectors[vectors.any(axis=1) == 0] = 1
    rows = [(i, v.tolist(), "") for i, v in enumerate(vectors)]
    got = answers(neighbours.search(table(spark, rows), F.col("vec_id") % 100 == 0, count=count, visit=1e9, block=100))
    assert got == exact(list(range(600)), vectors.astype(np.float64), range(0, 600, 100), count)


def test_budget_grows_more_slowly_than_the_table():
    rows = [10**k for k in range(1, 10)]
    visited = [neighbours.budget(n) * n for n in rows]
    assert neighbours.budget(neighbours.LEAST // neighbours.TREES) >= neighbours.TREES
    assert all(b / a < 10**0.83 for a, b in zip(visited[3:], visited[4:], strict=False)) and visited == sorted(visited)


def test_a_queue_ends_with_its_budget():
    rng = np.random.default_rng(5)
    sample = rng.standard_normal((2000, 8))
    forest = neighbours.fit_forest(sample, float(np.linalg.norm(sample, axis=1).max()), trees=4, depth=5)
    share = forest.share.ravel()
    for visit in (0.05, 0.5, 2.9):
        for leaves, priority in zip(forest.visited(sample[:20], visit), forest.priorities(sample[:20]).reshape(20, -1), strict=True):
            assert share[leaves].sum() >= visit > share[leaves[:-1]].sum()
            assert priority[leaves].min() >= np.delete(priority, leaves).max()
    assert all(len(leaves) == len(share) for leaves in forest.visited(sample[:3], 4.0))
