import itertools
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prevalo.llm import quality_model as qm
from prevalo.llm.queries import op7_quality_model


def plain_marginals(score, pairs):
    """Sums over all labellings."""
    good, total, expected = np.zeros(len(score)), 0.0, np.zeros((2, 2))
    for labels in itertools.product((0, 1), repeat=len(score)):
        weight = np.exp(sum(s for s, y in zip(score, labels, strict=True) if y) + sum(pairs[a, b] for a, b in zip(labels, labels[1:], strict=False)))
        total += weight
        good += weight * np.array(labels)
        for a, b in zip(labels, labels[1:], strict=False):
            expected[a, b] += weight
    return good / total, expected / total


def test_marginals_equal_sums_over_all_labellings():
    rng = np.random.default_rng(1)
    pairs = rng.standard_normal((2, 2))
    chains = [rng.standard_normal(n) for n in (3, 0, 1, 6, 6, 2)]
    want = [plain_marginals(c, pairs) for c in chains if len(c)]
    good, expected = qm.marginals(np.concatenate(chains), qm.steps_of(np.array([len(c) for c in chains])), pairs)
    assert np.allclose(good, np.concatenate([g for g, _ in want]))
    assert np.allclose(expected, sum(e for _, e in want))


def test_extreme_scores_stay_finite():
    good, _ = qm.marginals(np.array([1e6, -1e6, 1e6]), qm.steps_of(np.array([3])), np.zeros((2, 2)))
    assert good == pytest.approx([1.0, 0.0, 1.0])


def test_features_of_neighbours():
    x, n = qm.document(b"AB cd\n\n  \n1 2!\nAB cd")
    assert x.shape == (3, 3 * qm.OWN) and n.tolist() == [5, 4, 5]
    assert (x[1, qm.OWN : 2 * qm.OWN] == x[0, : qm.OWN]).all() and (x[1, 2 * qm.OWN :] == x[2, : qm.OWN]).all()
    assert not x[0, qm.OWN : 2 * qm.OWN].any() and x[0, qm.OWN - 1] == 0 and x[2, qm.OWN - 1] == 1


def corpus(n):
    rng = random.Random(2)
    for i in range(n):
        words = ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
        good = i % 4 != 0
        lines = [" ".join(w if good else w.upper() + "!!" for w in words[k : k + 12]) for k in range(0, 60, 12)]
        yield i, "\n".join(lines), int(good)


def test_learns_and_scores(spark, documents):
    rows = list(corpus(240))
    df = documents([(i, t) for i, t, _ in rows]).withColumns({"label": F.lit("clash"), "lines": F.lit(0)})
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:160]] + [(None, 1), (3, None), (9999, 0)], "doc_id long, label int")
    field = qm.learn(df, labels)
    again = qm.learn(df, labels)
    assert (field.weights == again.weights).all()
    got = {r.doc_id: r.score for r in qm.score(df, field).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in rows[160:])
    odd = documents([(1, None), (1, None), (2, ""), (3, "  \n "), (4, "x" * 300_000), (5, "ok line\n" * 5000), (None, "a")])
    scores = {r.doc_id: r.score for r in qm.score(odd, field).collect()}
    assert scores[1] == scores[2] == scores[3] == field.prior and all(0 <= s <= 1 for s in scores.values())


def test_no_labels(spark, documents):
    field = qm.learn(documents([(1, "a b")]), spark.createDataFrame([], "doc_id long, label int"))
    assert [r.score for r in qm.score(documents([(1, "a b"), (2, None)]), field).collect()] == [0.5, 0.5]
    assert qm.score(documents([]), field).count() == 0


def test_sample_is_bounded(spark, documents):
    rows = list(corpus(60))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    assert qm.learn(documents([(i, t) for i, t, _ in rows]), labels, sample=20).prior == pytest.approx(0.75, abs=0.25)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op7_quality_model(spark, d).collect()
    out = [r for r in rows if r.held_out and r.doc_id in quality]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == quality[r.doc_id] for r in out) >= 0.95 * len(out)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100, 2049])
def test_blocks_of_a_long_chain_give_the_marginals_of_the_chain(n):
    rng = np.random.default_rng(n)
    score, pairs = rng.normal(0, 3, n), rng.normal(0, 2, (2, 2))
    want, _ = qm.marginals(score, qm.steps_of(np.array([n])), pairs)
    assert np.allclose(qm.chain_marginals(score, pairs), want, atol=1e-9)


def test_a_text_of_many_lines_takes_seconds():
    field = qm.Field(np.random.default_rng(1).normal(0, 1, 3 * qm.OWN), np.array([[1.0, -1], [-1, 1]]), 0.5)
    text = "".join(f"line {i} of a long text\n" for i in range(200_000)).encode()
    start = time.perf_counter()
    (one,), both = qm.score_batch([text], field), qm.score_batch([b"short\nlines", text, None], field)
    assert time.perf_counter() - start < 20 and both[1] == pytest.approx(one) and 0 <= one <= 1 and both[2] == 0.5
