"""Suffix-array deduplication: bytes of stretches that a document with a smaller id holds as well.

A byte is removed if it is covered by a stretch of ``SPAN`` bytes that also starts in a document with a smaller
id. Stretches are compared as they stand in the input, and never across documents.

Sorting the suffixes of all documents in one place would move every position of the corpus. Instead:

1. Texts are dealt into blocks by a hash. In every stretch the ``GRAM`` bytes with the smallest hash are its *anchor*,
   so equal stretches have equal anchors; about one position in fourteen is one. Blocks send the sorted anchor hashes they have, each once.
2. Buckets of hashes tell each block which of its anchors other documents have too.
3. Blocks send the context of those anchors: the bytes of all stretches that share the anchor, each distinct context once, with
   the smallest and largest id that has it. A passage that is in all documents is one context of each block. At
   its ends every document has a context of its own; where an anchor has more than ``HOT`` places, its stretches go
   to buckets by their own hashes, so that no bucket gets all of them.
4. Buckets sort the contexts' suffixes (``suffixes``), grouped by anchor and place. Equal stretches become neighbours, verified by
   their bytes, and the smallest id of each class goes back to the blocks it concerns.
5. Blocks remove what is covered by stretches whose smallest id is below the document's own.

The texts are shuffled once, by block; the exchange is shared by steps 1, 3 and 5. What steps 2 and 4 send
back is bits and runs. Blocks and buckets have the same sizes on average whatever the input; a bucket's contexts can be several times its share of the text.

Cases: a null text is an empty one; texts under ``SPAN`` bytes lose nothing; a null id is larger than any other, and 2^63 - 1 counts as null; rows
with the same id never remove each other's bytes; empty tables give empty results. Columns named in ``keep`` are carried along in
the struct ``doc``; others are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from prevalo.llm.common import WORD, give_back, python_workers
from prevalo.llm.suffixes import Hashed, sort_suffixes

SPAN, GRAM = 50, 24
#: Bytes of text in a block, and of those whose anchors meet in a bucket, on average.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Stretches whose anchors are found at a time.
CHUNK = 1 << 18
#: Places with one anchor beyond which its stretches are dealt out by their own hashes.
HOT = 1 << 14
#: Contexts whose stretches are sorted at a time, or all of one anchor if they are more.
CONTEXTS = 1 << 12
#: Stretches that are sorted at a time, or all with one anchor in one place if they are more.
STRETCHES = 1 << 15
HASH_BITS = 48
NO_ID = (1 << 63) - 1

PARTS = "bucket int, block int, data binary"
PARTS_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers, or bytes, as one compressed value. Equal bytes of neighbouring numbers come to stand together."""
    out = [len(columns).to_bytes(2, "little")]
    for c in columns:
        c = np.ascontiguousarray(c)
        planes = c.view(np.uint8).reshape(-1, c.itemsize).T.tobytes()
        kind = c.dtype.str.encode().ljust(4)
        out.append(kind + len(planes).to_bytes(8, "little") + planes)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 2, []
    for _ in range(int.from_bytes(raw[:2], "little")):
        kind, size = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        planes = np.frombuffer(raw, np.uint8, size, at + 12).reshape(kind.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += 12 + size
    return out


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


class Block:
    """The documents of a block, one after the other, and the anchors of their stretches.

    at, first, last: the anchor's place and the first and last stretch it is the anchor of; doc: whose it is;
    key: its hash.
    """

    def __init__(self, ids: np.ndarray, texts: list[bytes], span: int = SPAN, gram: int = GRAM) -> None:
        self.order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.ids = ids[self.order]
        self.span = span
        sizes = np.array([len(texts[i]) for i in self.order], np.int64)
        self.stops = np.cumsum(sizes)
        self.starts = self.stops - sizes
        self.raw = b"".join(texts[i] for i in self.order)
        data = np.frombuffer(self.raw, np.uint8)
        width, parts = span - gram + 1, [np.zeros((5, 0), np.int64)]
        for c in range(0, len(data) - span + 1, CHUNK):
            seg = data[c : c + CHUNK + span - 1]
            h = Hashed(seg).grams(gram)
            places = np.uint64((1 << 21) - 1)
            least = (h & ~places) | np.arange(len(h), dtype=np.uint64)
            reach = 1
            while 2 * reach <= width:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            n = len(seg) - span + 1
            place = (np.minimum(least[:n], least[width - reach : width - reach + n]) & places).astype(np.int64)
            owner = np.searchsorted(self.stops, np.arange(c, c + n), side="right")
            whole = np.arange(c + span, c + n + span) <= self.stops[owner]
            change = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1])
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            stops = np.concatenate([starts[1:], [n]]) - 1
            good = whole[starts]
            starts, stops = starts[good], stops[good]
            key = (h[place[starts]] * np.uint64(BASE_KEY)) >> np.uint64(64 - HASH_BITS)
            parts.append(np.stack([place[starts] + c, starts + c, stops + c, owner[starts], key.view(np.int64)]))
        self.at, self.first, self.last, self.doc, self.key = np.concatenate(parts, axis=1)
        self.keys, self.back = np.unique(self.key, return_inverse=True)

    def shared_inside(self) -> np.ndarray:
        """Whether documents with different ids in this block have the anchor's key."""
        low, high = np.full(len(self.keys), NO_ID), np.full(len(self.keys), -NO_ID - 1)
        np.minimum.at(low, self.back, self.ids[self.doc])
        np.maximum.at(high, self.back, self.ids[self.doc])
        return low < high

    def contexts(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """Number the distinct contexts of the anchors that ``shared`` (by key) marks, in the order of the documents.

        use_begin, use_doc, context: where the context of each anchor begins, whose it is, and its number; texts,
        low, high, keys_of, offsets: the contexts' bytes, ids, keys and where their anchors stand in them.
        A hot anchor's stretches are contexts of their own, with their own hash as the key.
        """
        used = np.flatnonzero(shared[self.back])
        whole = ~hot[self.back[used]]
        calm, parted = used[whole], used[~whole]
        count = self.last[parted] - self.first[parted] + 1
        single = np.repeat(self.first[parted], count) + _within(count)
        self.use_begin = np.concatenate([self.first[calm], single])
        self.use_doc = np.concatenate([self.doc[calm], np.repeat(self.doc[parted], count)])
        ends = np.concatenate([self.last[calm], single]) + self.span
        known: dict[bytes, int] = {}
        raw = self.raw
        bounds = zip(self.use_begin.tolist(), ends.tolist(), strict=True)
        self.context = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in bounds), np.int64, len(ends))
        self.texts = list(known)
        self.low, self.high = np.full(len(known), NO_ID), np.full(len(known), -NO_ID - 1)
        np.minimum.at(self.low, self.context, self.ids[self.use_doc])
        np.maximum.at(self.high, self.context, self.ids[self.use_doc])
        first = np.full(len(known), len(ends))
        np.minimum.at(first, self.context, np.arange(len(ends)))
        anchored = first < len(calm)
        self.keys_of, self.offsets = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        of = calm[first[anchored]]
        self.keys_of[anchored], self.offsets[anchored] = self.key[of], self.at[of] - self.first[of]
        for i in np.flatnonzero(~anchored).tolist():
            self.keys_of[i] = xxhash.xxh64_intdigest(self.texts[i]) >> (64 - HASH_BITS)

    def spans(self, runs: list[np.ndarray]) -> list[list[tuple[int, int]]]:
        """Removed spans of each document, from runs (context, first stretch, last stretch, smallest id)."""
        edges = np.zeros(len(self.raw) + 1, np.int64)
        if runs:
            context, begin, end, least = (np.concatenate(c) for c in zip(*runs, strict=True))
            order = np.argsort(context, kind="stable")
            context, begin, end, least = context[order].astype(np.int64), begin[order], end[order], least[order]
            low, high = np.searchsorted(context, self.context), np.searchsorted(context, self.context, side="right")
            use = np.repeat(np.arange(len(self.context)), high - low)
            hit = _within(high - low) + np.repeat(low, high - low)
            below = least[hit] < self.ids[self.use_doc[use]]
            use, hit = use[below], hit[below]
            np.add.at(edges, self.use_begin[use] + begin[hit], 1)
            np.add.at(edges, self.use_begin[use] + end[hit] + self.span, -1)
        gone = np.cumsum(edges[:-1]) > 0
        out = []
        for a, b in zip(self.starts.tolist(), self.stops.tolist(), strict=True):
            turn = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)))
            out.append([*zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)])
        return out


BASE_KEY = 0xFF51AFD7ED558CCD


def _block(docs: pa.Table) -> Block:
    return Block(docs.column("id").to_numpy(), docs.column("data").to_pylist())


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys.astype(np.float64) * (buckets / (1 << HASH_BITS))).astype(np.int64)


def _parts(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    give_back()
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, PARTS_ARROW.types, strict=True)], schema=PARTS_ARROW)


def _slices(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each bucket and where its rows are; the buckets come sorted."""
    found, starts = np.unique(buckets, return_index=True)
    for k, a, b in zip(found.tolist(), starts.tolist(), np.append(starts, len(buckets))[1:].tolist(), strict=True):
        yield k, slice(a, b)


def _send_keys(buckets: int):
    def send(docs: pa.Table) -> pa.Table:
        block, number = _block(docs), docs.column("block")[0].as_py()
        inside, often = block.shared_inside(), np.bincount(block.back, minlength=len(block.keys)).clip(max=65535).astype(np.uint16)
        found = _slices(_bucket(block.keys, buckets))
        return _parts([(k, number, pack(np.diff(block.keys[s], prepend=0), inside[s], often[s])) for k, s in found])

    return send


def _mark_shared(most: int):
    def shared(rows: pa.Table) -> pa.Table:
        """Step 2: for each block two bits for each of its keys, in their order: whether another document has it, and whether it is hot."""
        blocks, read = rows.column("block").to_pylist(), [unpack(x) for x in rows.column("data").to_pylist()]
        keys = np.concatenate([np.cumsum(k) for k, _, _ in read])
        found, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        several = count > 1
        several[back[np.concatenate([x for _, x, _ in read])]] = True
        hot = np.bincount(back, np.concatenate([n for _, _, n in read])) > most
        ends = np.cumsum([len(k) for k, _, _ in read])[:-1]
        cuts = zip(blocks, np.split(several[back], ends), np.split(hot[back], ends), strict=True)
        bucket = rows.column("bucket")[0].as_py()
        return _parts([(bucket, b, pack(np.packbits(x), np.packbits(y))) for b, x, y in cuts if x.any()])

    return shared


def _with_contexts(docs: pa.Table, answers: pa.Table, buckets: int) -> Block:
    block = _block(docs)
    bits = {b: unpack(d) for b, k, d in zip(*(answers.column(c).to_pylist() for c in ("bucket", "step", "data")), strict=True) if k == 2}
    shared, hot = np.zeros(len(block.keys), bool), np.zeros(len(block.keys), bool)
    for k, s in _slices(_bucket(block.keys, buckets)):
        if k in bits:
            shared[s], hot[s] = (np.unpackbits(x, count=s.stop - s.start).astype(bool) for x in bits[k])
    block.contexts(shared, hot)
    return block


def _send_contexts(buckets: int):
    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _parts([])
        block, number = _with_contexts(docs, answers, buckets), docs.column("block")[0].as_py()
        key, offset = block.keys_of, block.offsets.astype(np.uint8)
        where = _bucket(key, buckets)
        order = np.argsort(where, kind="stable")
        rows = []
        for k, s in _slices(where[order]):
            e = order[s]
            texts = [block.texts[i] for i in e]
            sizes = np.array([len(t) for t in texts], np.uint8)
            data = np.frombuffer(b"".join(texts), np.uint8)
            rows.append((k, number, pack(e.astype(np.uint32), key[e], offset[e], sizes, block.low[e], block.high[e], data)))
        return _parts(rows)

    return send


def _cuts(sorted_keys: np.ndarray, step: int) -> np.ndarray:
    """Bounds of slices of about ``step`` rows that no key is divided by."""
    heads = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
    wanted = np.searchsorted(heads, np.arange(0, len(sorted_keys), step)).clip(max=len(heads) - 1)
    return np.append(heads[np.unique(wanted)], len(sorted_keys))


def _least(key: np.ndarray, offset: np.ndarray, low: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, stretch, smallest id of the stretch's class) of all stretches of these contexts."""
    count = size - SPAN + 1
    item, place = np.repeat(np.arange(len(size), dtype=np.int32), count), _within(count).astype(np.int32)
    at = (np.cumsum(size) - size).astype(np.int32)[item] + place
    # Only stretches with the same anchor in the same place can be equal.
    group = key[item] * 128 + (place - offset[item] + 64)
    order = np.argsort(group, kind="stable").astype(np.int32)
    text, least = Hashed(data), np.empty(len(item), np.int64)
    cuts = _cuts(group[order], STRETCHES)
    for a, b in zip(cuts, cuts[1:], strict=False):
        some = order[a:b]
        inner, same = sort_suffixes(text, at[some], group[some], SPAN)
        some = some[inner]
        least[some] = np.minimum.reduceat(low[item[some]], np.flatnonzero(~same))[np.cumsum(~same) - 1]
    return item, place, least


def _classes(rows: pa.Table) -> pa.Table:
    """Step 4: sort the contexts' stretches, some anchors' at a time, and send back runs of them with the smallest id of their class."""
    blocks, read = rows.column("block").to_pylist(), [unpack(x) for x in rows.column("data").to_pylist()]
    raw = b"".join(r.pop().tobytes() for r in read)
    owner = np.repeat(np.arange(len(read), dtype=np.int32), [len(r[0]) for r in read])
    entry, key, offset, size, low, high = (np.concatenate(c) for c in zip(*read, strict=True))
    del read
    stops = np.cumsum(size, dtype=np.int64)
    by_key = np.argsort(key, kind="stable").astype(np.int32)
    cuts = _cuts(key[by_key], CONTEXTS)
    found: list[tuple[np.ndarray, ...]] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        e = by_key[a:b]
        some = size[e].astype(np.int64)
        text = b"".join([raw[z - n : z] for z, n in zip(stops[e].tolist(), some.tolist(), strict=True)])
        item, place, least = _least(key[e], offset[e].astype(np.int64), low[e], some, np.frombuffer(text, np.uint8))
        matters = least < high[e[item]]
        item, place, least = e[item[matters]], place[matters], least[matters]
        new = (np.diff(item, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 1) | (np.diff(least, prepend=0) != 0)
        begin = np.flatnonzero(new)
        end = np.append(begin, len(item))[1:] - 1
        found.append((owner[item[begin]], entry[item[begin]], place[begin].astype(np.uint8), place[end].astype(np.uint8), least[begin]))
    block, *runs = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(block, kind="stable")
    bucket = rows.column("bucket")[0].as_py()
    return _parts([(bucket, blocks[k], pack(*(c[order[s]] for c in runs))) for k, s in _slices(block[order])])


def _remove(buckets: int, schema: pa.Schema, readable: bool):
    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        block = _with_contexts(docs, answers, buckets)
        runs = [unpack(d) for d, k in zip(answers.column("data").to_pylist(), answers.column("step").to_pylist(), strict=True) if k == 4]
        spans = block.spans(runs)
        kept, removed = [], []
        for a, b, gone in zip(block.starts.tolist(), block.stops.tolist(), spans, strict=True):
            edges = [a, *(a + x for span in gone for x in span), b]
            kept.append(b"".join(block.raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            removed.append([{"start": x, "stop": y} for x, y in gone])
        doc = docs.column("doc").take(pa.array(block.order))
        sizes = pa.array((block.stops - block.starts).tolist(), pa.int64())
        give_back()
        columns = [doc, sizes, pa.array(removed, schema.field("spans").type), pa.array(kept, pa.binary())]
        if readable:
            columns[-1] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        return pa.Table.from_arrays(columns, schema=schema)

    return remove


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", readable: bool = False) -> DataFrame:
    """(doc, n_bytes, spans, kept): removed spans (start, stop) in bytes of each text, and the bytes that are left. readable: kept is
    a string, without the rest of characters of which a byte is removed."""
    spark = docs.sparkSession
    python_workers(spark)
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    blocks, buckets = -(-size // BLOCK_BYTES) or 1, -(-size // BUCKET_BYTES) or 1
    # The hash of the whole row, so that rows with one id are not one block.
    number = F.pmod(F.xxhash64("doc_id", text), F.lit(blocks)).cast("int")
    rows = docs.select(number.alias("block"), F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"), data.alias("data"), F.struct(*keep).alias("doc"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 8))
    rows = rows.repartition(tasks, "block")

    keys = rows.groupBy("block").applyInArrow(_send_keys(buckets), PARTS)
    shared = keys.groupBy("bucket").applyInArrow(_mark_shared(HOT), PARTS).withColumn("step", F.lit(2))
    contexts = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_send_contexts(buckets), PARTS)
    classes = contexts.groupBy("bucket").applyInArrow(_classes, PARTS).withColumn("step", F.lit(4))
    result = "doc " + docs.select(F.struct(*keep).alias("doc")).schema["doc"].dataType.simpleString()
    result += ", n_bytes long, spans array<struct<start: long, stop: long>>, kept " + ("string" if readable else "binary")
    schema = to_arrow_schema(spark.createDataFrame([], result).schema)
    answers = shared.unionByName(classes)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_remove(buckets, schema, readable), result)


def without_repeats(docs: DataFrame) -> DataFrame:
    """Documents without their repeated passages; those of which no word is left go. A character of which
    a byte is removed goes as a whole. ``n_chars``, if there is one, follows the text; a text that loses nothing stays as it is."""
    others = tuple(c for c in docs.columns if c != "text")
    flag = max(docs.columns, key=len) + "_null"
    left = remove_repeats(docs.withColumn(flag, F.col("text").isNull()), (*others, flag), readable=True)
    left = left.withColumn("text", F.when(~F.col(f"doc.`{flag}`"), F.col("kept"))).where((F.size("spans") == 0) | F.col("text").rlike(WORD))
    length = F.when(F.size("spans") > 0, F.length("text").cast("bigint"))
    columns = [F.col("text") if c == "text" else F.coalesce(length, F.col("doc.n_chars")).alias(c) if c == "n_chars" else F.col(f"doc.`{c}`") for c in docs.columns]
    return left.select(*columns)
