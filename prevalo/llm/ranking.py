"""Ranked lexical search with per-term geometric blocking.

A document's score for an item is a sum over the item's terms, repeats included, of the term's weight times its impact in the document. Terms,
weights and impacts are whole numbers, so scores are exact.

1. Documents are read once for a group of items. What leaves the reading tasks of a document is its number of terms and, for the terms that
   occur in an item, number and frequency. Counts of documents, terms and document frequencies are added up by Spark.
2. Tasks then take the documents in blocks. Within a block every term has a posting list, and every posting list is divided by the similarity
   of its documents: short random projections of the documents' impacts are compared with those of some of the list's own documents, and each document
   joins the nearest. Such a *geometric block* has a summary, the largest impact of each coordinate over its documents.
3. An item is searched in the posting lists of the terms without which no document can reach its threshold (the largest impacts of all
   other terms together stay below it). A geometric block whose summary's score is below the threshold is skipped: no document in it can score more.
   Documents of the others are scored in full.
4. The threshold of an item is the score of its ``COUNT``-th best document so far. It starts with that of the best of at most ``SAMPLE``
   documents, which is a lower bound of the final one, and rises from block to block of a task. Documents that equal
   it are kept, and the smaller id decides at the end.

Summaries are exact, over all coordinates that an item with the list's term can have, so nothing is lost by skipping. Items come in groups of
about ``TERMS`` distinct terms by a hash, each group with a reading pass of its own; within a task they are searched in subgroups of ``WIDTH`` terms, so that a block is a
matrix of bounded size. One item may have more terms than either, as it is one row. Driver and broadcasts hold a group's items.

Cases: null texts and texts without terms have none and never rank; an item without terms has no rows; items that stand on several rows with one
text count once, and those with different texts each have their own ranks; rows with one document id rank each; a null document id is larger than any other;
an empty table gives an empty result. Other columns are ignored. Whole texts count, however long, in pieces.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prevalo.llm.common import give_back, python_workers, stage
from prevalo.llm.words import word_lists

COUNT = 10
#: Distinct terms of a group of items, of a subgroup that is searched together, entries of a block's matrix, and its largest number of documents.
TERMS, WIDTH, ENTRIES, BLOCK = 1 << 18, 4096, 1 << 23, 4096
#: Documents of a geometric block on average, and components of the projections by which they are compared.
LIST, SKETCH = 4, 16
SAMPLE = 4096

FOUND = "item long, doc_id long, nameless boolean, score long"
SCHEMA = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("nameless", pa.bool_()), ("score", pa.int64())])
VECTOR = pa.struct([("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def term_counts(text: bytes | None) -> Counter:
    """Terms of a whole text with their frequencies."""
    out: Counter = Counter()
    for words in word_lists(text):
        out.update(words)
    return out


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def impacts(counts: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The terms' impacts in documents of n terms: counts and n have the same shape."""
    m = 25 + 75 * n.astype(np.int64) * documents // max(1, terms)
    c = counts.astype(np.int64)
    return 1_000_000_000 * c // (1000 * c + 8 * m)


@dataclass
class Subgroup:
    """Some items over at most WIDTH terms: items' numbers, their terms' columns, and a matrix of weights (terms x items, repeats included)."""

    items: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    #: For each column the places of the items that have it, and the columns that those items have.
    having: list[np.ndarray] = field(default_factory=list)
    beside: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        there = self.weights > 0
        self.having = [np.flatnonzero(row) for row in there]
        self.beside = [np.flatnonzero(there[:, items].any(axis=1)) for items in self.having]
        #: Products and sums of doubles are exact up to 2^53.
        self.exact = float(self.weights.sum(axis=0).max(initial=0)) * 1e6 < float(1 << 53)


def subgroups(items: list[tuple[int, dict[int, int]]], weights: dict[int, int], width: int = WIDTH) -> list[Subgroup]:
    """Items (number, {term: repeats}) in subgroups of up to ``width`` terms; one item may have more."""
    parts: list[tuple[set[int], list[tuple[int, dict[int, int]]]]] = []
    for number, terms in items:
        own = {t for t in terms if weights.get(t, 0) > 0}
        if not own:
            continue
        if not parts or len(parts[-1][0] | own) > width:
            parts.append((set(), []))
        parts[-1][0].update(own)
        parts[-1][1].append((number, terms))
    out = []
    for own, some in parts:
        columns = np.array(sorted(own), np.int64)
        table = np.zeros((len(columns), len(some)), np.int64)
        for k, (_, terms) in enumerate(some):
            known = [t for t in terms if weights.get(t, 0) > 0]
            table[np.searchsorted(columns, known), k] = [weights[t] * terms[t] for t in known]
        out.append(Subgroup(np.array([n for n, _ in some], np.int64), columns, table))
    return out


class Best:
    """The best documents of each item so far, and the score that a further one needs."""

    def __init__(self, floors: np.ndarray, count: int = COUNT) -> None:
        self.floors, self.count = floors, count
        self.rows: list[np.ndarray] = [np.zeros((3, 0), np.int64)] * len(floors)
        self.skipped = self.scored = 0

    def add(self, item: int, ids: np.ndarray, nameless: np.ndarray, scores: np.ndarray) -> None:
        rows = np.concatenate([self.rows[item], np.stack([-scores, nameless, ids])], axis=1)
        order = np.lexsort((rows[2], rows[1], rows[0]))[: self.count]
        self.rows[item] = rows[:, order]
        if len(order) == self.count:
            self.floors[item] = max(self.floors[item], -rows[0, order[-1]])


def divided(near: np.ndarray, size: int = LIST) -> np.ndarray:
    """A block's number for each document of a posting list, from their projections: that of the nearest of some documents, spread over the list."""
    blocks = -(-len(near) // size)
    if blocks == 1:
        return np.zeros(len(near), np.int64)
    centres = near[np.linspace(0, len(near) - 1, blocks).astype(np.int64)]
    return (near @ centres.T).argmax(axis=1)


def search_block(group: Subgroup, matrix: np.ndarray, ids: np.ndarray, nameless: np.ndarray, best: Best, size: int = LIST) -> None:
    """Search all items of a subgroup in a block of documents. matrix: impacts, documents x terms."""
    kind = np.float64 if group.exact else np.int64
    most = matrix.max(axis=0, initial=0).astype(np.int64)
    # Per item: terms by falling share of the score; those from which on all together stay below the threshold need no search.
    reach = group.weights * most[:, None]
    order = np.argsort(-reach, axis=0, kind="stable")
    falling = np.take_along_axis(reach, order, axis=0)
    rest = falling[::-1].cumsum(axis=0)[::-1]
    needed = np.zeros(reach.shape, bool)
    np.put_along_axis(needed, order, (rest >= best.floors[group.items]) & (falling > 0), axis=0)
    lists = np.flatnonzero(needed.any(axis=1))
    if not len(lists):
        return
    random = np.random.default_rng(7).standard_normal((matrix.shape[1], SKETCH)).astype(np.float32)
    near = matrix.astype(np.float32) @ random
    near /= np.maximum(np.sqrt((near**2).sum(axis=1)), 1e-30)[:, None]
    seen = np.zeros((len(group.items), len(ids)), bool)
    # Rare terms first: their documents raise the thresholds at which others are skipped.
    for t in lists[np.argsort((matrix[:, lists] > 0).sum(axis=0), kind="stable")].tolist():
        docs = np.flatnonzero(matrix[:, t])
        items = group.having[t][needed[t, group.having[t]]]
        beside = group.beside[t]
        block = divided(near[docs], size)
        by_block = np.argsort(block, kind="stable")
        docs, block = docs[by_block], block[by_block]
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        own = matrix[np.ix_(docs, beside)].astype(kind)
        weights = group.weights[np.ix_(beside, items)].astype(kind)
        summary = np.maximum.reduceat(own, starts, axis=0)
        alive = summary @ weights >= best.floors[group.items[items]]
        rows = np.repeat(alive, np.diff(np.append(starts, len(docs))), axis=0)
        best.skipped += int((~rows).sum())
        some = rows.any(axis=1)
        if not some.any():
            continue
        scores = (own[some] @ weights).astype(np.int64)
        docs, rows = docs[some], rows[some]
        for k, i in enumerate(items.tolist()):
            number = int(group.items[i])
            good = rows[:, k] & (scores[:, k] >= best.floors[number]) & ~seen[i, docs]
            best.scored += int(rows[:, k].sum())
            if good.any():
                seen[i, docs[good]] = True
                best.add(number, ids[docs[good]], nameless[docs[good]].astype(np.int64), scores[good, k])


@dataclass
class Search:
    """What tasks need of a group of items."""

    groups: list[Subgroup]
    floors: np.ndarray
    documents: int
    terms: int

    def run(self, batches: Iterator[pa.RecordBatch], count: int = COUNT) -> Best:
        """The best documents of rows (doc_id, n, terms, counts)."""
        best = Best(self.floors.copy(), count)
        for batch in batches:
            ids, n = batch.column(0), batch.column(1).to_numpy()
            nameless = np.array(ids.is_null())
            ids = ids.fill_null(0).to_numpy()
            offsets = batch.column(2).offsets.to_numpy()
            terms, counts = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            for group in self.groups:
                step = int(max(1, min(BLOCK, ENTRIES // len(group.terms))))
                for a in range(0, len(ids), step):
                    z = min(a + step, len(ids))
                    own = slice(offsets[a], offsets[z])
                    doc = np.repeat(np.arange(z - a), np.diff(offsets[a : z + 1]))
                    at = np.searchsorted(group.terms, terms[own]).clip(max=len(group.terms) - 1)
                    fits = group.terms[at] == terms[own]
                    doc, at = doc[fits], at[fits]
                    matrix = np.zeros((z - a, len(group.terms)), np.int32)
                    matrix[doc, at] = impacts(counts[own][fits], n[a:z][doc], self.documents, self.terms)
                    search_block(group, matrix, ids[a:z], nameless[a:z], best)
        return best


def _batch(best: Best) -> pa.RecordBatch:
    items = np.repeat(np.arange(len(best.rows)), [r.shape[1] for r in best.rows])
    score, nameless, ids = np.concatenate([*best.rows, np.zeros((3, 0), np.int64)], axis=1)
    columns = [pa.array(items), pa.array(ids), pa.array(nameless == 1), pa.array(-score)]
    return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


def with_vectors(docs: DataFrame, vocabulary: dict[bytes, int], text: Column) -> DataFrame:
    """(doc_id, n, terms, counts): all terms of a text, and the vocabulary's terms in it, sorted, with their frequencies."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def vectors(texts: pa.Array) -> pa.Array:
        known, total, sizes, terms, counts = shared.value, [], [0], [], []
        for t in texts.to_pylist():
            n, found = 0, Counter()
            for words in word_lists(t):
                n += len(words)
                found.update(map(known.get, words))
            found.pop(None, None)
            own = sorted(found)
            total.append(n)
            terms.append(np.array(own, np.int32))
            counts.append(np.array([found[k] for k in own], np.int32))
            sizes.append(sizes[-1] + len(own))
        offsets = pa.array(sizes, pa.int32())
        flat = [np.concatenate([*x, np.zeros(0, np.int32)]) for x in (terms, counts)]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(f, pa.int32())) for f in flat]
        give_back()
        return pa.StructArray.from_arrays([pa.array(total, pa.int64()), *lists], fields=list(VECTOR))

    vectors.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(vectors, "n long, terms array<int>, counts array<int>")
    return docs.select("doc_id", udf(text.cast("binary")).alias("v")).select("doc_id", "v.*").where("n > 0")


def _items(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): distinct items with a number and their terms with repeats."""

    def counted(texts: pa.Array) -> pa.Array:
        rows = [[{"term": t, "repeats": n} for t, n in sorted(term_counts(x).items())] for x in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("term", pa.binary()), ("repeats", pa.int64())])))

    counted.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(counted, "array<struct<term: binary, repeats: long>>")
    rows = items.select("item_id", F.col("text").cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    return rows.select("item_id", F.monotonically_increasing_id().alias("item"), udf("text").alias("terms")).where(F.size("terms") > 0)


def _group(docs: DataFrame, items: DataFrame, count: int, sample: int) -> DataFrame:
    """(item_id, item, doc_id, nameless, score): the best documents of each task for a group of items (item_id, item, terms)."""
    spark = docs.sparkSession
    rows = items.select("item", "terms").orderBy("item").collect()
    vocabulary = {t: k for k, t in enumerate(sorted({bytes(x["term"]) for r in rows for x in r["terms"]}))}
    found = stage(with_vectors(docs.select("doc_id", "text"), vocabulary, F.col("text")), "vectors")
    documents, terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()
    weights = {r["term"]: weight(documents, r["n"]) for r in often}
    numbered = [(k, {vocabulary[bytes(x["term"])]: x["repeats"] for x in r["terms"]}) for k, r in enumerate(rows)]
    groups = subgroups(numbered, weights)

    # A lower bound of each item's last score: that of a sample.
    first = found.orderBy(F.xxhash64("doc_id", "terms"), "doc_id").limit(sample).toArrow().combine_chunks()
    floors = Search(groups, np.ones(len(rows), np.int64), documents, terms).run(iter(first.to_batches()), count).floors
    search = spark.sparkContext.broadcast(Search(groups, floors, documents, terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _batch(search.value.run(batches, count))
        give_back()
        yield out

    numbers = spark.createDataFrame([(k, r["item"]) for k, r in enumerate(rows)], "number long, item long")
    named = items.select("item_id", "item").join(numbers, "item").select("item_id", F.col("item").alias("own"), "number")
    best = found.select("doc_id", "n", "terms", "counts").mapInArrow(run, FOUND)
    return best.join(named, best["item"] == named["number"]).select("item_id", F.col("own").alias("item"), "doc_id", "nameless", "score")


def rank(docs: DataFrame, items: DataFrame, count: int = COUNT, terms: int = TERMS, sample: int = SAMPLE) -> DataFrame:
    """(item_id, rank, doc_id, score): the documents (doc_id, text) with the highest scores above 0 for each item (item_id, text)."""
    spark = docs.sparkSession
    python_workers(spark)
    known = stage(_items(items), "items")
    groups = -(-(known.agg(F.sum(F.size("terms"))).first()[0] or 0) // terms)
    found: DataFrame | None = None
    for k in range(groups):
        some = known.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == k)
        part = _group(docs, some, count, sample)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "nameless", "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    return ranked.select("item_id", "rank", F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), "score")
