"""Document quality by a linear-chain conditional random field over lines.

Every line of a document is good or bad. A line's features are shares of character classes, word
repetition and whether it repeats an earlier line, those of the line before and after it, and a constant; a chain of weights
between neighbouring labels lets context decide doubtful lines. Forward-backward gives each line's
marginal probability of being good; their mean, weighted by the lines' length, is the document's quality.

The field is fitted by gradient ascent on the conditional likelihood. Labels exist for documents, and are taken
for all their lines. Fitting uses at most ``SAMPLE`` labelled documents of at most ``SAMPLE_BYTES`` bytes, those with the
smallest hash of their id; scoring covers every document and its whole text.

Cases: a null text, or one without words, gets the share of good documents in the sample; without any
labels all scores are that of an even chance; labels that are null are ignored; an id with several labels counts as good if any is; repeated rows are scored
each; an empty table gives an empty result. Other columns stay; the result is one column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prevalo.llm.common import python_workers

SAMPLE, SAMPLE_BYTES = 3000, 200_000
#: Documents longer than this are fitted as several chains.
CHAIN = 200
ROUNDS, RATE, RIDGE = 120, 0.1, 1e-4

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS, MARKS, SHOUTS, DIGITS = b"#*$%&|<>", b".,;:?'\"()-_=+/", b"!", b"0123456789"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
HIGH = bytes(range(128, 256))
OWN = 12


def line_features(line: bytes, words: list[bytes], repeated: bool) -> tuple[float, ...]:
    """Shares of a line that has at least one word."""
    solid = line.translate(None, SPACE)
    n, k = len(solid), len(words)

    def share(chars: bytes) -> float:
        return (n - len(solid.translate(None, chars))) / n

    return (
        1.0,
        min(n, 1000) / 1000,
        share(UPPER),
        share(LOWER + HIGH),
        share(SYMBOLS),
        share(MARKS),
        share(SHOUTS),
        share(DIGITS),
        min(n / k, 20.0) / 20,
        sum(map(eq, words, words[1:])) / k,
        1 - len(set(words)) / k,
        float(repeated),
    )


def document(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (with those of both neighbours) and lengths of the lines that have a word."""
    rows, lengths, seen = [], [], set()
    for line in (text or b"").split(b"\n"):
        words = line.split()
        if words:
            rows.append(line_features(line, words, line in seen))
            lengths.append(len(line))
            seen.add(line)
    own = np.array(rows, np.float32).reshape(len(rows), OWN)
    edge = np.zeros((1, OWN), np.float32)
    before, after = np.concatenate([edge, own])[:-1], np.concatenate([own, edge])[1:]
    return np.concatenate([own, before, after], axis=1), np.array(lengths, np.float64)


@dataclass
class Field:
    """Weights of the good label's features (the bad label's are 0), of label pairs, and the share of good documents."""

    weights: np.ndarray
    pairs: np.ndarray
    prior: float


def _log_add(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def steps_of(lengths: np.ndarray) -> list[np.ndarray]:
    """Where the first, second, ... lines of chains are that lie one after the other, the longest chain first."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    alive = len(lengths) - np.searchsorted(lengths[order][::-1], np.arange(lengths.max(initial=0)), side="right")
    return [starts[order[:n]] + t for t, n in enumerate(alive)]


def marginals(score: np.ndarray, steps: list[np.ndarray], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line from its score, and the expected number of each pair of labels.

    All chains advance together, so that each step is a few operations on arrays.
    """
    both = np.stack([np.zeros(len(score)), score], axis=1)
    ahead: list[np.ndarray] = []
    for t, at in enumerate(steps):
        ahead.append(both[at] if t == 0 else both[at] + _log_add(ahead[-1][: len(at), :, None] + pairs, 1))
    good, expected = np.empty(len(score)), np.zeros((2, 2))
    back, after = np.zeros((0, 2)), np.zeros((0, 2))
    for t in range(len(steps) - 1, -1, -1):
        here = np.zeros((len(steps[t]), 2))
        if len(back):
            next_ = (after + back)[:, None, :] + pairs
            here[: len(back)] = _log_add(next_, 2)
            joint = ahead[t][: len(back), :, None] + next_
            joint -= _log_add(_log_add(joint, 2), 1)[:, None, None]
            expected += np.exp(joint).sum(axis=0)
        total = ahead[t] + here
        good[steps[t]] = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500)))
        back, after = here, both[steps[t]]
    return good, expected


#: Stands for the logarithm of 0 where sums are formed of it.
NEVER = -1e30
#: Lines from which a chain is scored in blocks, with the same result.
LONG = 2048


def chain_marginals(score: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """P(good) of every line of one long chain.

    The chain is cut into about as many blocks as they have lines. A block is a product of one 2 x 2 matrix a line; all blocks'
    products grow side by side, then a pass over the blocks gives what enters each from either end, and
    all blocks are run through once more from there. So a chain of n lines takes some 4 sqrt(n) steps on arrays.
    """
    n = len(score)
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    step = np.full((blocks * size, 2, 2), NEVER)
    step[:, [0, 1], [0, 1]] = 0.0  # lines that fill the last block change nothing
    step[:n] = pairs
    step[:n, :, 1] += score[:, None]
    step[0] = [[0.0, score[0]], [NEVER, NEVER]]
    step = step.reshape(blocks, size, 2, 2)
    product = step[:, 0]
    for j in range(1, size):
        product = _log_add(product[:, :, :, None] + step[:, j, None], 2)
    enters, leaves = np.empty((blocks, 2)), np.empty((blocks, 2))
    enters[0], leaves[-1] = [0.0, NEVER], 0.0
    for k in range(1, blocks):
        enters[k] = _log_add(enters[k - 1][:, None] + product[k - 1], 0)
        leaves[-k - 1] = _log_add(product[-k] + leaves[-k], 1)
    ahead, behind = np.empty((size, blocks, 2)), np.empty((size, blocks, 2))
    for j in range(size):
        enters = ahead[j] = _log_add(enters[:, :, None] + step[:, j], 1)
        behind[size - 1 - j] = leaves
        leaves = _log_add(step[:, size - 1 - j] + leaves[:, None], 2)
    total = (ahead + behind).transpose(1, 0, 2).reshape(-1, 2)[:n]
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500)))


def fit_field(chains: list[np.ndarray], labels: list[int]) -> Field:
    """Gradient ascent (with moments) on the mean conditional log-likelihood of a line."""
    width = 3 * OWN
    prior = float(np.mean(labels)) if labels else 0.5
    parts = [(c[i : i + CHAIN], y) for c, y in zip(chains, labels, strict=True) for i in range(0, len(c), CHAIN)]
    if not parts or len(set(labels)) < 2:
        return Field(np.zeros(width), np.zeros((2, 2)), prior)
    x = np.concatenate([p for p, _ in parts]).astype(np.float64)
    # Features of like spread: one rate suits all weights.
    spread = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    x /= spread
    y = np.concatenate([np.full(len(p), label, float) for p, label in parts])
    steps = steps_of(np.array([len(p) for p, _ in parts]))
    seen = np.zeros((2, 2))
    for p, label in parts:
        seen[label, label] += len(p) - 1
    theta = np.zeros(width + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, ROUNDS + 1):
        good, expected = marginals(x @ theta[:width], steps, theta[width:].reshape(2, 2))
        slope = np.concatenate([x.T @ (y - good), (seen - expected).ravel()]) / len(x) - RIDGE * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta += RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return Field(theta[:width] / spread, theta[width:].reshape(2, 2), prior)


def score_batch(texts: list[bytes | None], field: Field) -> list[float]:
    read = [document(t) for t in texts]
    count = np.array([len(n) for _, n in read], np.int64)
    lines = np.concatenate([x for x, _ in read]) if read else np.empty((0, 3 * OWN))
    scores, short = lines @ field.weights, np.repeat(count <= LONG, count)
    good = np.empty(len(scores))
    good[short], _ = marginals(scores[short], steps_of(count[count <= LONG]), field.pairs)
    for k, stop in enumerate(np.cumsum(count).tolist()):
        if count[k] > LONG:
            good[stop - count[k] : stop] = chain_marginals(scores[stop - count[k] : stop], field.pairs)
    parts = np.split(good, np.cumsum(count)[:-1]) if read else []
    return [float((g * n).sum() / n.sum()) if len(n) else field.prior for g, (_, n) in zip(parts, read, strict=True)]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on the labelled documents among ``docs`` (doc_id, text); ``labels`` has doc_id and a 0/1 label."""
    python_workers(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    # Twice the sample, for labels without a document; a bounded list that Spark can send to the scan.
    order = F.xxhash64("doc_id")
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(order, "doc_id").limit(2 * sample)
    text = F.col("text").cast("binary")
    rows = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")

    @F.pandas_udf(T.BinaryType())
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([document(t)[0].tobytes() for t in texts], dtype=object)

    found = rows.select("doc_id", "label", packed("text").alias("lines")).orderBy(order, "doc_id").limit(sample).collect()
    chains = [np.frombuffer(r["lines"], np.float32).reshape(-1, 3 * OWN) for r in found]
    return fit_field(chains, [int(r["label"]) for r in found])


def score(docs: DataFrame, field: Field, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: the quality of each whole text, from 0 to 1."""
    spark = docs.sparkSession
    python_workers(spark)
    shared = spark.sparkContext.broadcast(field)

    @F.pandas_udf(T.DoubleType())
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(score_batch(texts.tolist(), shared.value), dtype="float64")

    return docs.withColumn(out, quality(F.col(text).cast("binary")))
