import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prevalo.llm import repeats, suffixes
from prevalo.llm.queries import op10_repeats


def plain_kept(rows, span=50):
    """What is left of each text, from a table of all stretches."""
    rows = [((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in rows:
        for s in range(len(t) - span + 1):
            first[t[s : s + span]] = min(first.get(t[s : s + span], i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for s in range(len(t) - span + 1):
            if first[t[s : s + span]] < i:
                gone[s : s + span] = b"\1" * span
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g), sum(gone), bytes(gone).replace(b"\0", b" ").split()))
    return [(kept, n, len(runs)) for kept, n, runs in out]


@pytest.mark.parametrize("letters", [1, 2, 200])
def test_sorted_suffixes_equal_the_plain_sort(letters):
    rng = np.random.default_rng(letters)
    data = rng.integers(0, letters, 3000).astype(np.uint8)
    at, group = rng.permutation(2950), rng.integers(0, 3, 2950)
    order, same = suffixes.sort_suffixes(suffixes.Hashed(data), at, group, 50)
    key = [(g, data[a : a + 50].tobytes()) for a, g in zip(at, group, strict=True)]
    assert [key[i] for i in order] == sorted(key) and sorted(order) == list(range(2950))
    assert same.tolist() == [False, *(key[a] == key[b] for a, b in zip(order, order[1:], strict=False))]


def test_common_extensions():
    data = np.frombuffer(b"abcabcabdabcabcabc", np.uint8)
    text = suffixes.Hashed(data)
    a, b = (x.ravel() for x in np.mgrid[0:10, 0:10])
    want = [next((k for k in range(8) if data[i + k] != data[j + k]), 8) for i, j in zip(a, b, strict=True)]
    assert text.common(a, b, 8).tolist() == want


def test_collisions_are_seen(monkeypatch):
    """Hashes that tell nothing apart: the order still comes out right, from the bytes."""
    monkeypatch.setattr(suffixes.Hashed, "stretch", lambda self, start, length: np.zeros(len(start), np.uint64))
    data = np.random.default_rng(1).integers(0, 3, 300).astype(np.uint8)
    at = np.arange(200)
    order, same = suffixes.sort_suffixes(suffixes.Hashed(data), at, np.zeros(200, int), 50)
    key = [data[a : a + 50].tobytes() for a in at]
    assert [key[i] for i in order] == sorted(key)


def test_packing():
    columns = [np.array([1, -5, 1 << 60]), np.array([], np.uint8), np.array([True, False]), np.arange(300).astype(np.uint32)]
    for a, b in zip(columns, repeats.unpack(repeats.pack(*columns)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def check(documents, rows):
    df = documents(rows).withColumns({"block": F.lit("clash"), "data": F.lit(1), "id": F.lit(2), "key": F.lit(3), "spans": F.lit(4)})
    got = repeats.remove_repeats(df, keep=("doc_id", "text", "data")).collect()
    have = [((r.doc.doc_id, r.doc.text), bytes(r.kept), sum(s.stop - s.start for s in r.spans), len(r.spans)) for r in got]
    want = sorted((((i, t), *w) for (i, t), w in zip(rows, plain_kept(rows), strict=True)), key=str)
    assert sorted(have, key=str) == want


@pytest.mark.parametrize("blocks", [(8000, 9000, 5), (1500, 1200, 40), (1 << 22, 1 << 24, 1 << 14)])
def test_equals_the_plain_removal(documents, monkeypatch, blocks):
    monkeypatch.setattr(repeats, "HOT", blocks[2])
    monkeypatch.setattr(repeats, "BLOCK_BYTES", blocks[0])
    monkeypatch.setattr(repeats, "BUCKET_BYTES", blocks[1])
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 120))) for _ in range(40)]
    rows = [(i if rng.random() < 0.9 else i // 2, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(500 + i, "a" * rng.randint(0, 200)) for i in range(12)] + [(None, "a" * 100), (None, parts[0] * 3), (7, None), (8, "")]
    check(documents, rows)


def test_anchors_of_chunks_are_those_of_the_whole(monkeypatch):
    rng = random.Random(7)
    ids, texts = np.arange(40), ["".join(rng.choice("abc") for _ in range(rng.randint(0, 400))).encode() for _ in range(40)]
    whole = repeats.Block(ids, texts)
    monkeypatch.setattr(repeats, "CHUNK", 97)
    parts = repeats.Block(ids, texts)

    def stretches(block):
        """The anchor's place and key of each stretch."""
        return {s: (p, k) for p, k, a, z in zip(block.at, block.key, block.first, block.last, strict=True) for s in range(a, z + 1)}

    assert stretches(whole) == stretches(parts)
    assert len(stretches(whole)) == sum(max(0, len(t) - 49) for t in texts)
    for s, (p, _) in stretches(whole).items():
        assert s <= p <= s + repeats.SPAN - repeats.GRAM


def test_long_texts(documents):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    check(documents, [(1, base), (2, base[3000:] + "Z" + base[:3000]), (3, base[:49]), (4, base[100:150]), (4, base), (5, "x" * 5000)])


@pytest.mark.parametrize("hot", [1, 30, 1 << 14])
def test_many_copies(documents, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    text = "the same passage of more than fifty bytes that everybody has copied somewhere"
    check(documents, [(i, text if i % 3 == 0 else f"{i} before {text} after {i}") for i in range(150)])


def test_empty_tables(documents):
    assert repeats.remove_repeats(documents([])).count() == 0
    assert repeats.without_repeats(documents([])).count() == 0


def test_documents_without_repeats(documents):
    passage = "é" * 25 + " a passage that is long enough to be found again, ünd more"
    rows = [(1, f"first {passage}", "en", "s"), (2, f"second à{passage}", "en", "s"), (3, passage, "en", "s"), (4, None, "en", "s"), (5, "", None, None)]
    got = {r.doc_id: r for r in repeats.without_repeats(documents(rows)).collect()}
    assert set(got) == {1, 2, 4, 5}
    assert got[1].text == rows[0][1] and got[2].text == "second à" and got[4].text is None and got[5].text == ""
    assert [got[i].n_chars for i in (1, 2, 4, 5)] == [len(rows[0][1]), 8, None, 0] and got[2].source == "s"


def test_whole_table(spark, text_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{text_dir}/documents.parquet").collect()]
    want = {i: (len(t.encode()), n, k, hashlib.sha256(kept).hexdigest()) for (i, t), (kept, n, k) in zip(rows, plain_kept(rows), strict=True)}
    assert {r.doc_id: tuple(r)[1:] for r in op10_repeats(spark, text_dir).collect()} == want
