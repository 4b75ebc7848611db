"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the largest inner product. Vectors are scaled by the largest norm M and get one more component,
sqrt(1 - |x|^2 / M^2), so that all have length one and the largest inner product is the smallest angle;
queries get 0 there. Each tree splits the space by hyperplanes halfway between two random sample points, at the median.
A query searches all trees through one queue: leaves of all trees are taken by falling priority, the
smallest margin by which the query lies on the leaf's side of the planes above it, until they hold a budget of rows. Rows found in these
leaves, and no others, are ranked by exact inner products in double precision.

The budget, in rows counted once for each tree that leads to them, is the larger of ``LEAST`` and ``SHARE`` times the table's rows times
(``SHARE_AT`` / rows) ^ ``FALL``: a query's work grows more slowly than the table. A budget of all trees' rows visits every
leaf, so tables of up to ``LEAST`` / ``TREES`` distinct vectors are searched exactly, and larger ones nearly so as long as LEAST decides.

The trees are fitted on at most ``SAMPLE`` vectors, those with the smallest hash of their id, and broadcast (``TREES`` x
2^``DEPTH`` planes, whatever the input). Every row is indexed: rows go to blocks of about ``BLOCK`` by a hash,
a task sorts its block into the leaves and answers the queries, which come in blocks of about ``QUERIES``; the best of all blocks
are merged for each query. Copies of a vector are indexed once, with the smallest of their ids; more of them could not be among the nearest.

Cases: vectors that are null, zero, or have a null or non-finite component take no part, nor do rows with a null id or a number of
components other than the most frequent one; queries with no candidates have no rows; with fewer candidates than asked for all are returned; of
equal scores, however many, the smallest ids are returned; an id's own rows are never its
candidates; repeated rows are candidates each and one query together; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prevalo.llm.common import python_workers, stage

TREES, DEPTH, SAMPLE = 32, 10, 20_000
LEAST, SHARE, SHARE_AT, FALL = 4096, 0.6, 10_000, 0.18
BLOCK, QUERIES = 32_768, 16_384
#: Queries whose priorities are held at a time.
AT_ONCE = 64

FOUND = "query_id long, vec_id long, score double"
SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


@dataclass
class Forest:
    """planes[t, k], offsets[t, k]: the split at node k of tree t (heap order); share[t, l]: part of the sample in leaf l."""

    planes: np.ndarray
    offsets: np.ndarray
    share: np.ndarray
    norm: float

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.norm
        return np.concatenate([scaled, np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(axis=1)))[:, None]], axis=1)

    def leaves(self, lifted: np.ndarray) -> np.ndarray:
        """(tree, row) -> leaf."""
        trees, inner = self.offsets.shape
        out = np.zeros((trees, len(lifted)), np.int64)
        for t in range(trees):
            node = out[t]
            for _ in range((inner + 1).bit_length() - 1):
                side = (lifted * self.planes[t, node]).sum(axis=1) > self.offsets[t, node]
                node[:] = 2 * node + 1 + side
            node -= inner
        return out

    def priorities(self, queries: np.ndarray) -> np.ndarray:
        """(query, tree, leaf) -> the smallest margin on the way to the leaf."""
        trees, inner = self.offsets.shape
        unit = queries / np.linalg.norm(queries, axis=1)[:, None]
        point = np.concatenate([unit, np.zeros((len(unit), 1))], axis=1)
        out = np.empty((len(queries), trees, inner + 1))
        for t in range(trees):
            margin = point @ self.planes[t].T - self.offsets[t]
            least = np.full((len(queries), 1), np.inf)
            first = 0
            while first < inner:
                here = margin[:, first : 2 * first + 1]
                least = np.minimum(np.repeat(least, 2, axis=1), np.stack([-here, here], axis=2).reshape(len(queries), -1))
                first = 2 * first + 1
            out[:, t] = least
        return out

    def visited(self, queries: np.ndarray, visit: float) -> Iterator[np.ndarray]:
        """For each query the leaves (tree * width + leaf) that the queue gives it before its budget ends."""
        share = self.share.ravel()
        if visit >= len(self.share):
            yield from [np.arange(len(share))] * len(queries)
            return
        # Enough leaves from the front of the queue, mostly; the whole queue if not.
        front = min(len(share), int(4 * visit * self.share.shape[1]) + 64)
        for priority in self.priorities(queries).reshape(len(queries), -1):
            for most in (front, len(share)):
                some = np.argpartition(-priority, most - 1)[:most] if most < len(share) else np.arange(len(share))
                order = some[np.argsort(-priority[some], kind="stable")]
                spent = np.cumsum(share[order])
                if spent[-1] >= visit or most == len(share):
                    break
            yield order[spent - share[order] < visit]


def budget(rows: int) -> float:
    """Rows that a query visits, as a multiple of the table's."""
    return max(LEAST / max(1, rows), SHARE * (SHARE_AT / max(1, rows)) ** FALL)


def fit_forest(sample: np.ndarray, norm: float, trees: int = TREES, depth: int = DEPTH, seed: int = 1) -> Forest:
    rng, inner = np.random.default_rng(seed), (1 << depth) - 1
    forest = Forest(np.zeros((trees, inner, sample.shape[1] + 1)), np.zeros((trees, inner)), np.zeros((trees, inner + 1)), norm)
    lifted = forest.lifted(sample)
    for t in range(trees):
        groups = {0: np.arange(len(lifted))}
        for node in range(inner):
            rows = groups.pop(node)
            if len(rows) > 1:
                a, b = rng.choice(rows, 2, replace=False)
                plane = lifted[a] - lifted[b]
                if not plane.any():
                    plane = rng.standard_normal(lifted.shape[1])
                plane /= np.linalg.norm(plane)
                value = lifted[rows] @ plane
                forest.planes[t, node], forest.offsets[t, node] = plane, np.median(value)
                side = value > forest.offsets[t, node]
            else:
                side = np.zeros(len(rows), bool)
            groups[2 * node + 1], groups[2 * node + 2] = rows[~side], rows[side]
        forest.share[t] = [len(groups[inner + k]) / max(1, len(lifted)) for k in range(inner + 1)]
    return forest


def search_block(
    forest: Forest, vectors: np.ndarray, queries: np.ndarray, count: int, visit: float, ids: list[list[int]], asking: list[int]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, scores): the best rows of a block for each query, best first, with all that equal the last one. Vectors that
    no id but the asking one has are left out."""
    first, single = np.array([i[0] for i in ids], np.int64), np.array([i[0] == i[-1] for i in ids], bool)
    leaf = forest.leaves(forest.lifted(vectors))
    trees, width = forest.share.shape
    leaf += np.arange(trees)[:, None] * width
    members = np.argsort(leaf.ravel(), kind="stable")
    edges = np.searchsorted(leaf.ravel()[members], np.arange(trees * width + 1))
    members %= len(vectors)
    found = np.zeros(len(vectors), bool)
    for i in range(0, len(queries), AT_ONCE):
        some = queries[i : i + AT_ONCE]
        for j, leaves in enumerate(forest.visited(some, visit)):
            sizes = edges[leaves + 1] - edges[leaves]
            at = np.repeat(edges[leaves] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            found[members[at]] = True
            rows = np.flatnonzero(found)
            found[rows] = False
            rows = rows[~single[rows] | (first[rows] != asking[i + j])]
            score = vectors[rows] @ some[j]
            if len(rows) > count:
                # The last bits of a product depend on how it is summed, so a little more than the last one is kept.
                least = np.partition(score, len(rows) - count)[len(rows) - count]
                rows = rows[score >= least - 1e-12 * max(1.0, abs(least))]
            exact = (vectors[rows] * some[j]).sum(axis=1)
            order = np.argsort(-exact, kind="stable")
            yield i + j, rows[order], exact[order]


def _matrix(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)[rows]


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def search(
    rows: DataFrame, is_query: Column, count: int = 20, visit: float | None = None, trees: int = TREES, depth: int = DEPTH, block: int = BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows (vec_id, embedding) that ``is_query`` marks."""
    spark = rows.sparkSession
    python_workers(spark)
    rows = rows.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull())
    rows = rows.where(F.coalesce(usable(F.col("embedding")), F.lit(False)))
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("embedding") == sizes[0]["dim"])

    # The smallest ids of each distinct vector, each as often as it has rows, up to the count: one id more than asked for, as one may be the query's own.
    copies = rows.groupBy("embedding", "vec_id").agg(F.count("*").alias("rows"))
    first = copies.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= count + 1)
    each = F.array_repeat("vec_id", F.least("rows", F.lit(count)).cast("int"))
    distinct = first.groupBy("embedding").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("ids"))
    distinct = stage(distinct, "vectors")

    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    total, longest = distinct.agg(F.count("*"), F.max(norm)).first()
    sample = distinct.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(SAMPLE).select("embedding").toPandas()
    forest = spark.sparkContext.broadcast(fit_forest(np.array(sample["embedding"].tolist(), np.float64), longest, trees, depth))

    asked = rows.where("is_query").select("vec_id", "embedding").distinct()
    blocks, parts = -(-total // block), -(-asked.count() // QUERIES)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    visit = budget(total) if visit is None else visit
    own, all_blocks = F.xxhash64(F.col("ids")[0]), F.sequence(F.lit(0), F.lit(blocks - 1))
    here = distinct.select(F.pmod(own, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "ids", "embedding")
    there = asked.select(
        F.explode(all_blocks).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.array("vec_id").alias("ids"), "embedding"
    )

    def answer(group: pa.Table) -> pa.Table:
        query = group.column("query").to_numpy()
        ids = group.column("ids").to_pylist()
        rows_, asked_ = np.flatnonzero(~query), np.flatnonzero(query)
        out: list[tuple[int, int, float]] = []
        if len(rows_) and len(asked_):
            vectors, queries = _matrix(group.column("embedding"), rows_), _matrix(group.column("embedding"), asked_)
            of_rows, asking = [ids[i] for i in rows_.tolist()], [ids[i][0] for i in asked_.tolist()]
            for q, found, scores in search_block(forest.value, vectors, queries, count, visit, of_rows, asking):
                me, mine = ids[asked_[q]][0], []
                for r, s in zip(found.tolist(), scores.tolist(), strict=True):
                    mine += [(me, v, s) for v in ids[rows_[r]] if v != me]
                # Equal scores of different vectors: the smaller id first.
                out += sorted(mine, key=lambda x: (-x[2], x[1]))[:count]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, SCHEMA.types, strict=True)], schema=SCHEMA)

    both = here.withColumn("query", F.lit(False)).unionByName(there.withColumn("query", F.lit(True)))
    found = both.groupBy("block", "part").applyInArrow(answer, FOUND)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= count)
    return ranked.select("query_id", "rank", "vec_id", "score")
