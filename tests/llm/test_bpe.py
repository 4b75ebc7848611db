import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prevalo.llm import bpe
from prevalo.llm.queries import op3_bpe, tokenizer_path


@pytest.fixture(scope="module")
def codec():
    with open(tokenizer_path(), encoding="utf-8") as f:
        return bpe.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def texts(count, seed):
    rng = random.Random(seed)
    alphabet = "abcdeXYZ   \n\t\r  éß中文　\x85\x1c\xa0<|>endoftext's're!!---===___1234567890²Ⅷ👍🏽‍́"
    for k in range(count):
        s = "".join(rng.choice(alphabet) for _ in range(rng.choice([3, 30, 300])))
        if k % 10 == 0:
            s += "<|endoftext|>" + s[:5] + "<|endoftext|><|endoftext"
        if k % 25 == 0:
            s += rng.choice("a-= é") * rng.choice([1000, 3000]) + "".join(rng.choice("abthe") for _ in range(2500))
        yield s


def test_ids_and_texts_equal_the_library(codec, library):
    for s in [*texts(400, 1), "", " ", "\n\n", "I'll say 'tis <|endoftext|>", "plain ascii  text\twith\x1c1 \x0b\x0c2  "]:
        ids = np.frombuffer(codec.encode(s), "<u4")
        assert ids.tolist() == library.encode(s, add_special_tokens=False).ids, s[:200]
        assert "".join(codec.decode(ids)) == library.decode(ids.tolist(), skip_special_tokens=False) == s
        broken = ids[1:-1:2]
        assert "".join(codec.decode(broken)) == library.decode(broken.tolist(), skip_special_tokens=False)


def test_streaming_equals_merging_at_once(codec):
    """Runs longer than the buffer, cut at every stride, give the tokens of the whole run."""
    rng = random.Random(2)
    for letters in ("ab", "the in", "-=", "a"):
        data = "".join(rng.choice(letters) for _ in range(6 * bpe.STRIDE)).encode()
        assert list(codec.stream(data)) == codec.merged(data)


def test_lookahead_bounds_how_far_a_change_reaches(codec):
    """Whatever follows, the tokens further than the lookahead from a common end agree."""
    rng = random.Random(3)
    for _ in range(30):
        stem = "".join(rng.choice("thereinandousal") for _ in range(codec.lookahead + 200)).encode()
        cuts = []
        for _ in range(3):
            ids = codec.merged(stem + "".join(rng.choice("thereinandousal") for _ in range(60)).encode())
            ends = np.cumsum([len(codec.bytes_of[i]) for i in ids])
            cuts.append([e for e in ends.tolist() if e <= len(stem) - codec.lookahead])
        assert cuts[0] == cuts[1] == cuts[2]


def test_lookahead_of_small_lists():
    """Tokens 0..3 are a, b, ab, bab: a change may move the boundary over b, then over ba."""
    assert bpe.sufficient_lookahead([(0, 1, 2)], [1, 1, 2], {2: (0, 1)}) == 1
    assert bpe.sufficient_lookahead([(0, 1, 2), (1, 2, 3)], [1, 1, 2, 3], {2: (0, 1), 3: (1, 2)}) == 2


def test_merge_lists_out_of_order_are_refused():
    spec = '{"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2, "abb": 3}, "merges": ["ab b", "a b"]}, "pre_tokenizer": {"type": "ByteLevel"}}'
    with pytest.raises(ValueError, match="no earlier merge"):
        bpe.Codec(spec)


def test_pieces_are_forgotten_but_not_lost(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 5)
    for s in texts(20, 4):
        assert np.frombuffer(codec.encode(s), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids


def test_columns(spark, documents, library):
    rows = [(1, "Hello wörld"), (1, "Hello wörld"), (2, None), (3, ""), (None, "x" * 200_000), (4, "<|endoftext|>")]
    df = documents(rows).withColumns({"n_tokens": F.lit("clash"), "decoded": F.lit(1)})
    both = bpe.decode_documents(bpe.encode_documents(df, tokenizer_path()), tokenizer_path(), out="back").collect()
    assert [list(r.ids) for r in both] == [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    assert [r.back for r in both] == [t or "" for _, t in rows]
    digest = bpe.round_trip(df, tokenizer_path()).select("n_tokens", "bpe.*").collect()
    for r, (_, t) in zip(digest, rows, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert r[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.round_trip(documents([]), tokenizer_path()).count() == 0


def test_whole_table(spark, text_dir, library):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{text_dir}/documents.parquet").collect()}
    for r in op3_bpe(spark, text_dir).collect():
        ids = library.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("window", [8, 13, 64])
def test_windows_cut_no_piece(codec, library, window):
    """Contractions, blanks and long runs at the edges of windows."""
    rng = random.Random(window)
    some = [*texts(150, window), "we're they'll I've it's 'tis" * 9, "a   b    c\n\n  d  " * 9, " " * 300 + "x", "x" + " " * 300, "ab" * 400 + " '" + "re" * 3]
    some += ["".join(rng.choice(["'", "r", "e", "l", " ", "  ", "\n", "é", "1", "!"]) for _ in range(300)) for _ in range(150)]
    for s in some:
        ids = np.frombuffer(b"".join(codec.encode_parts(s, window)), "<u4")
        assert ids.tolist() == library.encode(s, add_special_tokens=False).ids, s[:200]


@pytest.mark.parametrize("unit", ["plain words of a text, ", "wörter 中文 12 "])
def test_memory_beside_the_text_is_bounded(codec, unit):
    """A text and one four times as long take the same room, some windows' worth."""
    peaks = []
    for size in (300_000, 1_200_000):
        text = unit * (size // len(unit))
        bpe.digests_of(codec, text[:1000])
        tracemalloc.start()
        count, _, said = bpe.digests_of(codec, text)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert count > 0 and said == hashlib.sha256(text.encode()).hexdigest()
    assert peaks[1] < 1.2 * peaks[0] + 500_000 and peaks[1] < 20_000_000
