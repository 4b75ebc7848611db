"""SimHash near-duplicates through a Gray-order hierarchical index.

A text's fingerprint has a bit for each of 64 that more than half of its shingles' hashes have.
Fingerprints that differ in at most ``NEAR`` (two) bits are linked; a class is what links reach.

The index is a hierarchy of masked bit patterns. Its top nodes are the values of three blocks of bits: two
fingerprints within two bits agree on one of the three, so a node under which all fingerprints
share a block is all that has to be searched. Blocks are as wide as it takes for nodes of about ``NODE`` fingerprints. Fingerprints of nodes with more than ``CROWD`` are dealt out again
by three blocks of a third of all bits, and a node that is still crowded is divided by three blocks of the bits that aren't fixed yet, until none is: however many copies
gather around one fingerprint, a task gets at most ``CROWD`` at a time, and no link is lost. Within a node
fingerprints are sorted by Gray rank, in which neighbours differ little. Runs of them are factored into nodes that hold
the bits all below share, less those that their parent holds; a query adds up its differences on the way down
and leaves out whole groups once there are more than two. Every link is found so; fingerprints are compared one by one in the last
step down only.

Searches find links among distinct fingerprints, and pass on a spanning star of each node's links instead
of all pairs. Copies and equal fingerprints are never compared.

Cases: a null text, and one without words, has fingerprint 0 and is linked like any other; fewer than three words are
one shingle; null ids count as larger than any other, and a class of only null ids has a null id;
repeated rows get a row each; an empty table gives an empty result. Other columns stay in ``doc``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prevalo.llm.common import give_back, python_workers, stage
from prevalo.llm.components import components

SHINGLE, SEED, NEAR = 3, 42, 2
BITS, BLOCKS = 64, NEAR + 1
#: Fingerprints under one node of the distributed part, on average and at most; they are searched by an index in memory.
NODE, CROWD = 1024, 4096
#: Children of a node.
FAN = 16
#: Shingles hashed at a time.
CHUNK = 1 << 14


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(starts), CHUNK):
        spans = zip(starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    found = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
    give_back()
    return pd.Series(found)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add ``out``: the fingerprint of each whole text as a signed long of the same bits."""
    python_workers(docs.sparkSession)
    return docs.withColumn(out, _fingerprints(F.col(text).cast("binary")))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def divided(mask: int, parts: int = BLOCKS) -> list[int]:
    """The mask, and in each of ``parts`` masks also a block of the bits that it leaves open."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def top_masks(count: int, node: int = NODE) -> list[int]:
    """Three separate blocks of bits with about ``node`` of ``count`` fingerprints for each value of one; at most a third of all bits each."""
    width = min(BITS // BLOCKS, max(1, (count // node).bit_length()))
    return [((1 << width) - 1) << (BITS - width * (k + 1)) for k in range(BLOCKS)]


class GrayIndex:
    """Index over distinct fingerprints (unsigned, 64 bits)."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes[np.argsort(gray_rank(codes))]
        #: From the leaves up: the shared bits of each node and their values.
        levels = [(np.full(len(codes), ~np.uint64(0)), self.codes)]
        while len(levels[-1][0]) > FAN:
            mask, value = levels[-1]
            starts = np.arange(0, len(mask), FAN)
            ones = np.bitwise_and.reduceat(value & mask, starts)
            zeros = np.bitwise_and.reduceat(~value & mask, starts)
            levels.append((ones | zeros, ones))
        self.levels = levels

    def near(self, queries: np.ndarray, most: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
        """(query, place): all codes, by their place in Gray order, within ``most`` bits of each query."""
        mask, value = self.levels[-1]
        query = np.repeat(np.arange(len(queries)), len(mask))
        node = np.tile(np.arange(len(mask)), len(queries))
        spent = np.bitwise_count((queries[query] ^ value[node]) & mask[node]).astype(np.int64)
        for depth in range(len(self.levels) - 1, 0, -1):
            keep = spent <= most
            query, node, spent = query[keep], node[keep], spent[keep]
            above, (mask, value) = self.levels[depth][0][node], self.levels[depth - 1]
            child = node[:, None] * FAN + np.arange(FAN)
            there = child < len(mask)
            width = there.sum(axis=1)
            query, spent, above = np.repeat(query, width), np.repeat(spent, width), np.repeat(above, width)
            node = child[there]
            # Only what the parent doesn't hold is compared anew.
            spent = spent + np.bitwise_count((queries[query] ^ value[node]) & mask[node] & ~above)
        keep = spent <= most
        return query[keep], node[keep]


def stars(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, smallest of its class): the classes among distinct codes, without those alone."""
    index = GrayIndex(codes)
    codes = index.codes
    root = _joined(len(codes), (_pairs(index, i) for i in range(0, len(codes), 256)))
    least = np.full(len(codes), np.iinfo(np.int64).max)
    signed = codes.view(np.int64)
    np.minimum.at(least, root, signed)
    least = least[root]
    moved = least != signed
    return signed[moved], least[moved]


def _pairs(index: GrayIndex, start: int) -> tuple[np.ndarray, np.ndarray]:
    query, place = index.near(index.codes[start : start + 256])
    return query + start, place


def _joined(n: int, pairs) -> np.ndarray:
    """A root for each of n nodes, the same for all that pairs connect."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    return root


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, pattern, code) come sorted; a node that goes on in the next batch is kept for it."""
    rest = np.zeros((3, 0), np.int64)

    def found(rows: np.ndarray) -> pa.RecordBatch:
        change = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
        starts = np.concatenate([[0], change])
        ends = np.concatenate([change, [rows.shape[1]]])
        several = ends - starts > 1
        parts = [stars(rows[2, a:z].view(np.uint64)) for a, z in zip(starts[several], ends[several], strict=True)]
        u, v = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        rows = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
        if not rows.shape[1]:
            continue
        open_ = np.flatnonzero((rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1]))[0]
        rest = rows[:, open_:]
        if open_:
            yield found(np.ascontiguousarray(rows[:, :open_]))
    if rest.shape[1]:
        yield found(np.ascontiguousarray(rest))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def under(rows: DataFrame, which: Column) -> DataFrame:
    """(mask, pattern, code) of codes under some masks."""
    spread = rows.select("code", F.explode(which).alias("mask"))
    return spread.select("mask", F.col("code").bitwiseAND(F.col("mask")).alias("pattern"), "code")


def crowded(rows: DataFrame, crowd: int) -> DataFrame:
    """(mask, pattern) of the nodes with more than ``crowd`` codes."""
    many = rows.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    return stage(many.select("mask", "pattern"), "crowds")


def top_nodes(codes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(mask, pattern, code): the codes under nodes of about ``NODE``; those in crowded ones are dealt out again, by blocks of a third of all bits."""
    rows = under(codes, F.array(*[F.lit(_signed(m)) for m in top_masks(codes.count())]))
    crowds = crowded(rows, crowd)
    if crowds.isEmpty():
        return rows
    again = stage(rows.join(crowds, ["mask", "pattern"], "left_semi").select("code").distinct(), "nodes")
    return rows.join(crowds, ["mask", "pattern"], "left_anti").unionByName(nodes(again, divided(0), crowd))


def nodes(codes: DataFrame, masks: list[int], crowd: int = CROWD) -> DataFrame:
    """(mask, pattern, code): each code under every node of the hierarchy in which it is searched."""
    rows = under(codes, F.array(*[F.lit(_signed(m)) for m in masks]))
    done: DataFrame | None = None
    while True:
        crowds = crowded(rows, crowd)
        if crowds.isEmpty():
            return rows if done is None else done.unionByName(rows)
        calm = rows.join(crowds, ["mask", "pattern"], "left_anti")
        done = calm if done is None else done.unionByName(calm)
        finer = {m: divided(m) for m in masks}
        masks = [x for m in masks for x in finer[m]]
        table = F.create_map(*[x for m, kids in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in kids]))])
        rows = stage(under(rows.join(crowds, ["mask", "pattern"], "left_semi"), table[F.col("mask")]), "nodes")


def links(codes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(u, v): links among distinct codes (column ``code``) that connect all that are within ``NEAR`` bits."""
    python_workers(codes.sparkSession)
    rank = F.col("code")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    rows = top_nodes(codes, crowd).repartition("mask", "pattern")
    return rows.withColumn("rank", rank).sortWithinPartitions("mask", "pattern", "rank").drop("rank").mapInArrow(_search, "u long, v long")


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(doc, fingerprint, component_id, root) of each row; ``keep`` names what goes into doc."""
    rows = docs.select(F.struct(*keep).alias("doc"), F.col("doc_id").alias("id"), F.col(text).alias("text"))
    rows = stage(fingerprints(rows, "text").drop("text"), "fingerprints")
    first = stage(rows.groupBy(F.col("fingerprint").alias("code")).agg(F.min("id").alias("first")), "codes")
    tree = stage(components(links(first.select("code"))), "classes")
    known = labelled(rows.select("doc", F.col("fingerprint").alias("code")), first, tree)
    return known.select("doc", F.col("code").alias("fingerprint"), "component_id", "root")


def labelled(rows: DataFrame, first: DataFrame, tree: DataFrame) -> DataFrame:
    """(doc, code, component_id, root) of rows (doc, code): the smallest id and the smallest code of their class. first: (code,
    first), the smallest id of each code; tree: (node, root) of the codes with links. Classes that share an id share component_id, never root."""
    tree = tree.withColumnRenamed("node", "code")
    least = tree.join(first, "code").groupBy("root").agg(F.min("first").alias("class_first"))
    moved = tree.join(least, "root").select("code", "class_first", "root")
    known = first.join(moved, "code", "left").select("code", F.coalesce("class_first", "first").alias("component_id"), F.coalesce("root", "code").alias("root"))
    return rows.join(known, "code").select("doc", "code", "component_id", "root")


def first_of_each(docs: DataFrame, classes_of: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """One document of each class that ``classes_of(docs, keep)`` finds, the one with the smallest id; of rows with that id, one. Classes
    in which no row has an id keep one row for each distinct text."""
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    classes = classes_of(docs.withColumn("__digest", digest), ("doc_id", "__digest")).select("doc.*", "component_id", "root")
    own = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    own = own.groupBy("root", "component_id", F.when(F.col("component_id").isNull(), F.col("__digest")).alias("t"))
    own = stage(own.agg(F.min("__digest").alias("digest"), F.count("*").alias("rows")), "kept")
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("id"), digest.alias("own"))
    kept = whole.join(own, F.col("id").eqNullSafe(F.col("component_id")) & (F.col("own") == F.col("digest")))
    many = kept.where(F.col("rows") > 1).dropDuplicates(["id", "own"])
    return kept.where(F.col("rows") == 1).unionByName(many).select("doc.*")
