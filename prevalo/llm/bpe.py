"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

Merge lists have a *sufficient lookahead*: what stands more than so many bytes behind a place
cannot change the tokens that end before it. ``sufficient_lookahead`` computes such a bound from
the merge list alone. The encoder keeps a buffer of a few times that length, merges it, emits the
tokens that end further than the lookahead from its open end, and drops their bytes.

Texts are split before merging, so the buffer is one piece of the split, mostly; a piece within the buffer's length is merged at once and
a longer one is streamed through it, with the same tokens. Texts are split in windows of ``WINDOW`` characters, and ids
go on to the digest and the decoder window by window. So what is held beside the text itself doesn't grow with it, but for one piece that is longer than a
window (a run of one kind of characters), which is held with its ids. The decoder feeds
token bytes to an incremental UTF-8 state machine and emits text piece by piece.

Null texts are empty texts: no tokens, empty decoded text. Repeated rows each give a row. Other
columns are not read, so clashing names do no harm. The registered query reads ``doc_id`` and
``text`` only; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prevalo.llm.common import give_back, python_workers

#: Fixed value: how the byte-level vocabulary splits texts before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for texts of ASCII alone, in the faster standard module.
ASCII_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: Pieces of up to so many characters are remembered, in two generations of so many.
PIECE_CHARS, PIECES = 48, 120_000
#: Sorts behind every rule.
NO_RULE = (1 << 40, -1)
#: Bytes the encoder takes in at a time beyond the lookahead, tokens the decoder takes at a time.
STRIDE, TOKENS = 512, 4096
#: Characters that are split at a time, and how many of the last ones are split again with what follows: a contraction and its
#: apostrophe, or a run of blanks, are only certain if more text is seen.
WINDOW, UNSURE = 1 << 16, 4

RESULT = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def byte_symbols() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte, as character -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(rules: list[tuple[int, int, int]], lengths: list[int], parts: dict[int, tuple[int, int]]) -> int:
    """Bytes before an open end that the bytes behind it can still change.

    Let two texts share a prefix. At every moment of the merging there is a boundary before which
    both have the same tokens; at first it is the end of the prefix. Only a rule that crosses the
    boundary moves it, to the start of the rule's left part. The next crossing rule comes later in
    the list, and its right part begins with the left part of the one before (possibly grown to the
    right since). So the boundary moves along a chain of rules k1 < k2 < ... in which left(k_i) is
    found on the left spine of right(k_i+1), and moves by the length of left(k) each time. The bound
    is the greatest total length over such chains, found from the last rule to the first.

    rules: (left, right, product) in the order of the list.
    """
    best: dict[int, int] = {}
    longest = 0
    for left, right, _ in reversed(rules):
        reach = lengths[left] + best.get(left, 0)
        longest = max(longest, reach)
        while True:
            if reach > best.get(right, 0):
                best[right] = reach
            if right not in parts:
                break
            right = parts[right][0]
    return longest


class Codec:
    """Encoder and decoder of one vocabulary file (tokenizers JSON, byte-level BPE)."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model, symbols = data["model"], byte_symbols()
        if model["type"] != "BPE" or data.get("normalizer") or data["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        vocab: dict[str, int] = model["vocab"]
        special = {a["content"]: a["id"] for a in data.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(symbols[c] for c in word)
        for word, i in special.items():
            self.bytes_of[i] = word.encode()
        self.single = {self.bytes_of[i][0]: i for w, i in vocab.items() if len(w) == 1}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        rules, parts, made = [], {}, {}
        for n, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, out = vocab[a], vocab[b], vocab[a + b]
            if made.get(left, -1) >= n or made.get(right, -1) >= n or (len(a) > 1 and left not in made) or (len(b) > 1 and right not in made):
                raise ValueError("a merge uses a token that no earlier merge makes")
            if out not in made:
                made[out], parts[out] = n, (left, right)
            self.rank[left, right] = (n, out)
            rules.append((left, right, out))
        self.lookahead = sufficient_lookahead(rules, [len(x) for x in self.bytes_of], parts)
        self.special = special
        self.add_space = bool(data["pre_tokenizer"].get("add_prefix_space"))
        self.split, self.ascii_split = regex.compile(SPLIT), re.compile(ASCII_SPLIT)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)))
        self.known: dict[str, bytes] = _Pieces(self)

    def merged(self, data: bytes) -> list[int]:
        """Tokens of one short run of bytes: the earliest rule of the list first, then from the left."""
        ids = [self.single[b] for b in data]
        rule = self.rank.get
        rules = [rule(pair, NO_RULE) for pair in zip(ids, ids[1:], strict=False)]
        while rules and (first := min(rules)) is not NO_RULE:
            i, made = rules.index(first), first[1]
            ids[i : i + 2] = [made]
            del rules[i]
            if i:
                rules[i - 1] = rule((ids[i - 1], made), NO_RULE)
            if i < len(rules):
                rules[i] = rule((made, ids[i + 1]), NO_RULE)
        return ids

    def stream(self, data: bytes) -> Iterator[int]:
        """Tokens of a run of any length; holds lookahead + stride bytes and their tokens at a time."""
        start, end = 0, 0
        while start < len(data):
            end = max(end, start + self.lookahead) + STRIDE
            ids = self.merged(data[start:end])
            if end >= len(data):
                yield from ids
                return
            for i in ids:
                size = len(self.bytes_of[i])
                if start + size > end - self.lookahead:
                    break
                yield i
                start += size

    def piece(self, text: str) -> bytes:
        """Ids of one piece of the split, packed as little-endian unsigned 32-bit integers."""
        data = text.encode("utf-8", "surrogatepass")
        ids = self.merged(data) if len(data) <= STRIDE else np.fromiter(self.stream(data), "<u4")
        return np.asarray(ids, "<u4").tobytes()

    def segments(self, text: str, window: int = WINDOW) -> Iterator[bytes]:
        """Packed ids of a text without special tokens, some pieces at a time."""
        if self.add_space and text and not text[0].isspace():
            text = " " + text
        find = (self.ascii_split if text.isascii() else self.split).findall
        at, size = 0, window
        while at < len(text):
            if len(text) - at <= size:
                yield b"".join(map(self.known.__getitem__, find(text, at) if at else find(text)))
                return
            found = find(text, at, at + size)
            unsure = 0
            # At least two pieces: what the last one becomes can change the one before.
            for k in range(len(found)):
                if k > 1 and unsure > UNSURE:
                    break
                unsure += len(found.pop())
            if not found:
                size *= 2
                continue
            yield b"".join(map(self.known.__getitem__, found))
            at, size = at + size - unsure, window

    def encode_parts(self, text: str | None, window: int = WINDOW) -> Iterator[bytes]:
        """Packed ids of a text, part by part. Strings of special tokens in it become those tokens."""
        if not text:
            return
        at = 0
        if any(s in text for s in self.special):
            for m in self.specials.finditer(text):
                yield from self.segments(text[at : m.start()], window)
                yield self.special[m[0]].to_bytes(4, "little")
                at = m.end()
        for part in self.segments(text[at:] if at else text, window):
            yield part
            if len(self.known) > PIECES:
                self.known.age()

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text."""
        return b"".join(self.encode_parts(text))

    def decoded(self, parts: Iterable[bytes]) -> Iterator[str]:
        """Pieces of the text decoded from parts of packed ids; bytes that aren't UTF-8 become U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for part in parts:
            ids = np.frombuffer(part, "<u4")
            for i in range(0, len(ids), TOKENS):
                yield state.decode(b"".join(map(self.bytes_of.__getitem__, ids[i : i + TOKENS].tolist())))
        yield state.decode(b"", True)

    def decode(self, ids: Iterable[int] | np.ndarray) -> Iterator[str]:
        """Pieces of the text decoded from ids."""
        return self.decoded([np.asarray(ids, "<u4").tobytes()])


class _Pieces(dict):
    """Remembers short pieces; those not seen for a generation are forgotten, long ones never kept."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text) or self.codec.piece(text)
        if len(text) <= PIECE_CHARS:
            self[text] = ids
        return ids

    def age(self) -> None:
        self.old = dict(self)
        self.clear()


_CODECS: dict[str, Codec] = {}


def codec_of(name: str) -> Codec:
    """The codec of a file that ``ship`` gave to all executors; made once for each Python worker."""
    if name not in _CODECS:
        with open(SparkFiles.get(name), encoding="utf-8") as f:
            _CODECS[name] = Codec(f.read())
    return _CODECS[name]


def ship(df: DataFrame, path: str) -> str:
    """Give the vocabulary file (a path on the driver or in a store) to all executors, once."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rstrip("/").rsplit("/", 1)[-1]


def encode_documents(df: DataFrame, vocabulary: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the token ids of each whole text as an array of ints."""
    python_workers(df.sparkSession)
    name = ship(df, vocabulary)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_of(name)
        for texts in parts:
            yield pd.Series([np.frombuffer(codec.encode(t), "<u4").astype("i4") for t in texts], dtype=object)

    return df.withColumn(out, ids(F.col(text)))


def decode_documents(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of each array of token ids (null: empty)."""
    python_workers(df.sparkSession)
    name = ship(df, vocabulary)

    @F.pandas_udf(T.StringType())
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_of(name)
        for lists in parts:
            yield pd.Series(["".join(codec.decode([] if x is None else x)) for x in lists], dtype=object)

    return df.withColumn(out, texts(F.col(ids)))


def digests_of(codec: Codec, text: str | None) -> tuple[int, str, str]:
    """Number of tokens, digest of the ids and digest of the decoded text; neither ids nor decoded text are held whole."""
    count, ids, said = 0, hashlib.sha256(), hashlib.sha256()

    def seen() -> Iterator[bytes]:
        nonlocal count
        for part in codec.encode_parts(text):
            count += len(part) // 4
            ids.update(part)
            yield part

    for piece in codec.decoded(seen()):
        said.update(piece.encode("utf-8", "surrogatepass"))
    return count, ids.hexdigest(), said.hexdigest()


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", out: str = "bpe") -> DataFrame:
    """Add the struct ``out``: number of tokens, digest of the ids, digest of the text decoded from the ids.

    The ids of a window and a few thousand decoded tokens are held at a time.
    """
    python_workers(df.sparkSession)
    name = ship(df, vocabulary)

    @F.pandas_udf(RESULT)
    def digests(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = codec_of(name)
        for texts in parts:
            found = [digests_of(codec, t) for t in texts]
            give_back()
            yield pd.DataFrame(found, columns=RESULT.names)

    return df.withColumn(out, digests(F.col(text)))
