"""Benchmark decontamination by a prefix-filtered join of shingles, with exact containment of item-sized windows.

A window is ``WINDOW`` consecutive words of a benchmark item (all its words, if they are fewer). A word of a document is hit if it lies in
an occurrence of a window. To find occurrences, windows and documents are sets of shingles with places:

1. Items give their distinct windows, and each window its shingles of ``SHINGLE`` words (all its words, if they are fewer).
2. Documents are read once. A Bloom filter over the windows' shingles, at most 16 MB whatever the benchmark's size, keeps the places that
   may have one of them. As every shingle of an occurrence is one of the benchmark's, occurrences lie in runs of such places; runs that are
   too short for any window (the length bound) go. Only runs leave the task, as *passages*, each distinct one of a document once.
3. Equal passages of all documents are one passage from here on, so a paragraph in a third of all documents is searched once.
4. A shingle's rarity is the number of places in distinct passages that have it. Containment of a whole window needs all its shingles, so
   the necessary prefix is one shingle: windows are joined to passages by their rarest shingle; windows with a
   shingle that no passage has are dropped before.
5. The shingle's place in the window fixes where the occurrence would begin. It has to lie within the passage (the positional bound), and
   the window's words are compared with those that stand there.
6. Spans and items of the passages go back to the rows that have them; overlaps count once.

Rows without passages, nearly all, take part in nothing after step 2.

Cases: null texts, and texts without words, have no words and no windows; a null item id is an item with the empty string as its id; rows with
one item id are one item with the windows of all of them; repeated documents get a row each, under any id; an empty benchmark hits
nothing; an empty table gives an empty result. Very long texts are read in overlapping pieces. ``keep`` names the columns that go into
the struct ``doc``; their names clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prevalo.llm.common import give_back, python_workers, stage
from prevalo.llm.words import word_lists

WINDOW, SHINGLE = 10, 5
#: Bits of the filter for each shingle, and its least and largest size as powers of two.
BITS, LEAST, MOST = 32, 10, 27
PROBES = 3
#: Words of a text that are looked through at a time.
PART = 1 << 16

_RANDOM = np.random.default_rng(11)
_FACTOR = _RANDOM.integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

PIECES = pa.struct([("n_words", pa.int64()), ("found", pa.list_(pa.struct([("passage", pa.binary()), ("starts", pa.list_(pa.int64()))])))])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_keys(hashes: np.ndarray, size: int) -> np.ndarray:
    """A key for each run of ``size`` words, of which the hashes are given."""
    n = max(0, len(hashes) - size + 1)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _FACTOR[k]
    return mixed(total)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The filter's bits for each key, one array for each probe."""
    step = mixed(keys ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return [(keys + step * np.uint64(p)) >> np.uint64(64 - bits) for p in range(PROBES)]


class Filter:
    """words: 64 bits of the Bloom filter in each; runs: for each size of shingles the least number of places in a row that a window needs."""

    def __init__(self, words: np.ndarray, bits: int, runs: dict[int, int]) -> None:
        self.words, self.bits, self.runs = words, bits, runs

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        left = np.arange(len(keys))
        for place in places(keys, self.bits):
            at = place[left]
            left = left[(self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
        out = np.zeros(len(keys), bool)
        out[left] = True
        return out

    def passages(self, text: bytes | None) -> tuple[int, dict[bytes, list[int]]]:
        """(words of the text, where each distinct passage starts). Pieces overlap by a window, so that none is cut in all of them."""
        count, found, over = 0, {}, []
        for words in word_lists(text):
            words, first = over + words, count - len(over)
            count = first + len(words)
            over = words[max(0, len(words) - WINDOW + 1) :]
            for i in range(0, max(1, len(words) - WINDOW + 1), PART):
                part = words[i : i + PART + WINDOW - 1]
                hashes = word_hashes(part)
                for size, least in self.runs.items():
                    keys = shingle_keys(hashes, size)
                    good = np.concatenate([[False], self.may_have(keys), [False]]).astype(np.int8)
                    turn = np.flatnonzero(np.diff(good))
                    for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
                        if b - a >= least:
                            found.setdefault(b" ".join(part[a : b - 1 + size]), set()).add(first + i + a)
        return count, {p: sorted(s) for p, s in found.items()}


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, text) -> (item, window, n, keys)."""
    schema = pa.schema([("item", pa.string()), ("window", pa.binary()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))])
    for batch in batches:
        for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            over: list[bytes] = []
            several = False
            for more in word_lists(text):
                words = over + more
                if len(words) < WINDOW:
                    over = words
                    continue
                several, over = True, words[len(words) - WINDOW + 1 :]
                keys = shingle_keys(word_hashes(words), SHINGLE).view(np.int64)
                for i in range(0, len(words) - WINDOW + 1, 1 << 12):
                    at = range(i, min(i + (1 << 12), len(words) - WINDOW + 1))
                    columns = ([item] * len(at), [b" ".join(words[k : k + WINDOW]) for k in at], [WINDOW] * len(at), [keys[k : k + WINDOW - SHINGLE + 1] for k in at])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
            if over and not several:
                keys = shingle_keys(word_hashes(over), min(SHINGLE, len(over))).view(np.int64)
                columns = ([item], [b" ".join(over)], [len(over)], [keys])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
        give_back()


def windows_of(items: DataFrame) -> DataFrame:
    """(item, window, n, keys): the distinct windows of items (item_id, text) with the keys of their shingles, in order."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(_windows, "item string, window binary, n int, keys array<long>")
    return found.groupBy("item", "window").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))


def filter_of(windows: DataFrame) -> Filter:
    """The filter over all shingles of the windows. What reaches the driver are its words, at most 2^(MOST - 6)."""
    keys = windows.select(F.explode("keys").alias("key")).distinct()
    lengths = {r["n"] for r in windows.select("n").distinct().collect()}
    runs: dict[int, int] = {}
    for n in sorted(lengths, reverse=True):
        runs[min(n, SHINGLE)] = n - min(n, SHINGLE) + 1
    bits = min(MOST, max(LEAST, (BITS * max(1, keys.count()) - 1).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(places(batch.column(0).to_numpy().view(np.uint64), bits))
            word, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bit.view(np.int64))], names=["word", "bit"])

    rows = keys.mapInArrow(slots, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return Filter(words, bits, runs)


def with_passages(docs: DataFrame, filter_: Filter, text: Column) -> DataFrame:
    """Add ``pieces`` (n_words, found): the words of each whole text and its passages with their starts."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def pieces(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            count, found = shared.value.passages(t)
            rows.append({"n_words": count, "found": [{"passage": p, "starts": s} for p, s in found.items()]})
        out = pa.array(rows, PIECES)
        give_back()
        return out

    pieces.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(pieces, "n_words long, found array<struct<passage: binary, starts: array<long>>>")
    return docs.withColumn("pieces", udf(text.cast("binary")))


def _occurring(sizes: list[int]):
    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Passages -> (passage's key, place, shingle's key, words around the place, how many of them stand before it)."""
        schema = pa.schema([("pid", pa.string()), ("at", pa.int64()), ("key", pa.int64()), ("around", pa.binary()), ("before", pa.int32())])
        for batch in batches:
            for pid, passage in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = passage.split(b" ")
                hashes = word_hashes(words)
                for size in sizes:
                    keys = shingle_keys(hashes, size).view(np.int64)
                    for i in range(0, len(keys), 1 << 12):
                        at = range(i, min(i + (1 << 12), len(keys)))
                        begin = [max(0, k - WINDOW + 1) for k in at]
                        columns = ([pid] * len(at), at, keys[i : i + len(at)], [b" ".join(words[b : k + WINDOW]) for b, k in zip(begin, at, strict=True)], [k - b for b, k in zip(begin, at, strict=True)])
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
            give_back()

    return occurring


def matches(passages: DataFrame, windows: DataFrame, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """Spans (pid, start, stop) and items (pid, item) of the windows that occur in passages (pid, passage)."""
    places_ = stage(passages.mapInArrow(_occurring(sizes), "pid string, at long, key long, around binary, before int"), "places")
    common = places_.groupBy("key").agg(F.count("*").alias("often"))
    distinct = windows.groupBy("window").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    tokens = distinct.select("window", "n", F.size("keys").alias("tokens"), F.posexplode("keys").alias("offset", "key"))
    rare = F.min(F.struct("often", "key", "offset")).alias("rare")
    prefix = tokens.join(common, "key").groupBy("window").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.count("*").alias("there"), rare)
    prefix = prefix.where("there = tokens").select("window", "n", F.col("rare.key").alias("key"), F.col("rare.offset").alias("offset"))
    words = F.split(F.col("around").cast("string"), " ")
    first = F.col("before") - F.col("offset")
    fits = (first >= 0) & (first + F.col("n") <= F.size("words"))
    met = places_.join(stage(prefix, "prefixes"), "key").withColumn("words", words).where(fits)
    same = F.array_join(F.slice("words", first + 1, F.col("n")), " ").cast("binary") == F.col("window")
    hits = stage(met.where(same).select("pid", "window", (F.col("at") - F.col("offset")).alias("start"), "n"), "hits")
    spans = hits.select("pid", "start", (F.col("start") + F.col("n")).alias("stop")).distinct()
    items = hits.select("pid", "window").distinct().join(windows.select("window", "item"), "window").select("pid", "item").distinct()
    return spans, items


def joined_spans(spans: DataFrame) -> DataFrame:
    """(pid, spans): overlapping and touching spans of a passage made one."""
    order = Window.partitionBy("pid").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    run = fresh.withColumn("run", F.sum("fresh").over(order)).groupBy("pid", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return run.groupBy("pid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def decontaminate(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(doc, n_words, n_hit, spans, items) of each document: its words, those hit, spans (start, stop) of hit words, and the sorted ids, as
    strings, of the items (item_id, text) of which a window occurs."""
    python_workers(docs.sparkSession)
    windows = stage(windows_of(items), "windows")
    filter_ = filter_of(windows)
    rows = with_passages(docs.select(F.struct(*keep).alias("doc"), F.col(text).alias("text")), filter_, F.col("text"))
    rows = rows.select("doc", F.monotonically_increasing_id().alias("row"), "pieces.n_words", "pieces.found")
    rows = stage(rows, "passages")

    each = rows.select("row", F.explode("found").alias("p")).select("row", F.sha2("p.passage", 256).alias("pid"), "p.passage", "p.starts")
    distinct = stage(each.groupBy("pid").agg(F.first("passage").alias("passage")), "distinct")
    spans, named = matches(distinct, windows, list(filter_.runs))
    known = joined_spans(spans).join(named.groupBy("pid").agg(F.collect_set("item").alias("items")), "pid")
    own = each.select("row", "pid", "starts").join(stage(known, "known"), "pid")
    # A passage's spans, moved to each place at which the row has it.
    moved = F.flatten(F.transform("starts", lambda s: F.transform("spans", lambda x: F.struct((x["start"] + s).alias("start"), (x["stop"] + s).alias("stop")))))
    own = own.select("row", moved.alias("spans"), "items").groupBy("row")
    own = own.agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["stop"]).alias("end"), (a["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(a["end"], x["start"]))).alias("n")),
    )["n"]
    own = own.select("row", covered.alias("n_hit"), "spans", "items")
    dirty = rows.where(F.size("found") > 0).select("doc", "row", "n_words").join(own, "row", "left")
    clean = rows.where(F.size("found") == 0).select("doc", "n_words")
    hit = F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit")
    empty = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("spans", "array<struct<start: long, stop: long>>"), ("items", "array<string>"))]
    return dirty.select("doc", "n_words", hit, *empty).unionByName(clean, allowMissingColumns=True).select("doc", "n_words", hit, *empty)
