import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prevalo.llm import language
from prevalo.llm.queries import op5_language

TEXTS = [
    (1, "the cat and the dog sat on the mat and then the rain came", "en"),
    (2, "that is the thing with these three brothers, they think", "en"),
    (3, "der Hund und die Katze sind nicht in der Küche, sondern draußen", "de"),
    (4, "ich weiß nicht, was soll es bedeuten, daß ich so traurig bin", "de"),
    (5, "the the the", None),
    (6, None, "en"),
]


def plain_grams(text):
    out = Counter()
    for w in "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split():
        padded = f" {w} "
        out.update(w)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def number(gram):
    n = 0
    for c in gram:
        n = n << 21 | ord(c)
    return n


def plain_order(counts, most):
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:most]


def plain_nearest(text, profiles, length, own):
    counts = plain_grams(text or "")
    if not counts or not profiles:
        return "und", 0.0
    mine = plain_order(counts, own)
    best = None
    for lang in sorted(profiles):
        ranks = {g: i for i, g in enumerate(profiles[lang])}
        d = sum(abs(i - ranks[g]) if g in ranks else length for i, g in enumerate(mine))
        if best is None or d < best[0]:
            best = d, lang
    return best[1], 1 - best[0] / (length * len(mine))


def test_grams_equal_the_plain_ones():
    text = "Straße über l'été a b  cde 42_x"
    words = language.words_of(text)
    assert Counter(language.grams(words)[0].tolist()) == Counter({number(g): n for g, n in plain_grams(text).items()})
    got, place = language.grams(["ab", "c"])
    assert Counter(place.tolist()) == Counter({0: 2 + 3 + 2, 1: 1 + 2 + 1})


def test_partial_counts_add_up():
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "b", "a"], "text": ["the cat", "ein Hund", "the the dog"]})

    def total(most):
        out = Counter()
        for part in language._counted(iter([batch, batch]), most):
            for r in part.to_pylist():
                out[r["lang"], r["gram"]] += r["n"]
        return out

    assert total(1) == total(1000)
    assert total(1)["a", number(" th")] == 6


def test_profiles_and_predictions_equal_the_plain_ones(documents):
    df = documents(TEXTS)
    learned = language.learn(df, length=60)
    profiles = {}
    for lang in ("de", "en"):
        total = Counter()
        for _, t, x in TEXTS:
            if x == lang and t:
                total += plain_grams(t)
        profiles[lang] = plain_order(total, 60)
    assert learned[0] == ["de", "en"]
    for k, lang in enumerate(learned[0]):
        ranks = {int(g): int(r) for g, r in zip(learned[1], learned[2][k], strict=True) if r < 60}
        assert ranks == {number(g): i for i, g in enumerate(profiles[lang])}
    for t in ["the dog", "und nicht", "", None, "123 !", "ß", "x" * 100_000, "the über " * 50]:
        got, want = language.nearest(t, learned, 60, 25), plain_nearest(t, profiles, 60, 25)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1])


def test_numerals_are_no_letters(documents):
    learned = language.learn(documents(TEXTS))
    for text in ("½ ² ①", "ⅷ 四½"[:1], "² 3 _", "٣", "\u3007\u3007"):
        assert language.nearest(text, learned) == ("und", 0.0), text
    assert language.words_of("a²b x½ y") == ["a", "b", "x", "y"]
    assert language.nearest("the² dog①", learned)[0] == "en"


def test_ranked_breaks_ties_by_value():
    values = np.array([5, 5, 3, 3, 9, 1, 1, 1])
    assert language.ranked(values, 3).tolist() == [1, 3, 5]
    assert language.ranked(values, 99).tolist() == [1, 3, 5, 9]


def test_columns_and_nothing_to_learn(documents):
    df = documents([*TEXTS, (1, "the the", "en"), (None, "der", None)]).withColumn("score", F.lit("clash"))
    learned = language.learn(df)
    rows = language.predict(df, learned).collect()
    assert len(rows) == 8 and {r.score for r in rows} == {"clash"}
    assert [r.predicted.lang for r in rows][:4] == ["en", "en", "de", "de"] and rows[5].predicted == ("und", 0.0)
    empty = language.learn(documents([]))
    assert {r.predicted.lang for r in language.predict(df, empty).collect()} == {"und"}
    assert language.predict(documents([]), learned).count() == 0


def test_held_out_accuracy(spark, text_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{text_dir}/documents.parquet").collect()}
    rows = op5_language(spark, text_dir).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    out = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(out) >= 0.95 * len(out)
