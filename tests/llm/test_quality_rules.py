import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from prevalo.llm import quality_rules
from prevalo.llm.queries import op4_quality_rules


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(runs), set()
    for i, r in enumerate(runs):
        if often[r] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_counts_equal_the_plain_ones():
    rng = random.Random(1)
    texts = [None, "", " \n\x0b", "a b c d e a b c d e", "x\x85y\xa0z\x1cw", "a a a a a a"]
    texts += ["".join(rng.choice("aéb \n\t#|👍") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    texts += [" ".join(rng.choice("ab c") for _ in range(rng.randint(0, 70))) for _ in range(300)]
    for t in texts:
        assert quality_rules.counts_of(None if t is None else t.encode()) == plain_counts(t), t


def plain_estimate(x):
    """The same concentration steps in one place, with exact quantiles."""
    floor = np.square(quality_rules.FLOOR)
    low = lambda v: np.sort(v, axis=0)[(len(v) - 1) // 2]
    mean = low(x)
    scatter = np.diag((1.4826 * low(np.abs(x - mean))) ** 2)
    sizes = []
    for _ in range(quality_rules.STEPS):
        sizes.append(np.linalg.slogdet(scatter + np.diag(floor))[1])
        if len(sizes) > 2 and abs(sizes[-1] - sizes[-2]) <= quality_rules.STILL:
            break
        inverse = np.linalg.inv(scatter + np.diag(floor))
        d = np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
        edge = np.sort(d)[int(np.ceil(quality_rules.CENTRAL * len(d))) - 1]
        part = x[d <= edge]
        mean, scatter = part.mean(axis=0), quality_rules.CONSISTENT * np.cov(part.T, bias=True).reshape(5, 5)
    return mean, scatter, sizes


def test_estimates_equal_the_plain_ones(spark):
    rng = np.random.default_rng(2)
    cells = {"a": rng.multivariate_normal([5, 4, 0, 0, 0.1], np.diag([1, 0.2, 0.01, 0.02, 0.01]), 400), "b": rng.standard_normal((90, 5)), "c": rng.standard_normal((1, 5))}
    cells["a"][:60] += 9
    rows = [(k, *map(float, v)) for k, x in cells.items() for v in x]
    df = spark.createDataFrame(rows, "cell string, " + ", ".join(f"{v} double" for v in quality_rules.VECTOR))
    for r in quality_rules.fit(df).collect():
        mean, scatter, sizes = plain_estimate(cells[r.cell])
        assert np.allclose(r["mean"], mean) and np.allclose(np.reshape(r["scatter"], (5, 5)), scatter) and r.n == len(cells[r.cell])
        # After the start, which isn't a step's result, determinants never rise, and they stand still in the end.
        assert all(b <= a + 1e-9 for a, b in zip(sizes[1:], sizes[2:], strict=False)) and len(sizes) <= quality_rules.STEPS


def plain_verdicts(rows):
    """(doc_id, kept) from the definitions: counts, estimates of the table, languages and cells, each drawn towards the wider one."""
    vectors, cells = {}, {}
    for k, (_, text, lang, source) in enumerate(rows):
        n, chars, symbols, dups, repeats, lines = plain_counts(text)
        if n:
            vectors[k] = np.array([np.log1p(n), chars / n, np.sqrt(symbols / max(chars, 1)), np.sqrt(dups / max(lines, 1)), np.sqrt(repeats / n)])
            for key in ((), (lang,), (lang, source)):
                cells.setdefault(key, []).append(vectors[k])
    estimates = {}
    for key in sorted(cells, key=len):
        mean, scatter, _ = plain_estimate(np.array(cells[key]))
        estimates[key] = quality_rules.drawn(len(cells[key]), mean, scatter, *estimates[key[:-1]]) if key else (mean, scatter)
    out = []
    for k, (i, text, lang, source) in enumerate(rows):
        n, _, _, _, repeats, _ = plain_counts(text)
        kept = n >= 10 and 100 * repeats <= 20 * n
        if kept:
            mean, scatter = estimates[lang, source]
            d = vectors[k] - mean
            kept = d @ np.linalg.inv(scatter + np.diag(np.square(quality_rules.FLOOR))) @ d <= quality_rules.CUT
        out.append((i, bool(kept)))
    return out


def verdicts(df):
    return sorted(((r.doc.doc_id, r.kept) for r in quality_rules.judge(df).collect()), key=str)


def test_verdicts_end_to_end(documents):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(5, 300)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", None])) for i in range(160)]
    rows += [(200 + i, prose(rng, 60).replace(" ", rng.choice(["# ", " | ", "\n"])), "en", "a") for i in range(15)]
    rows += [(300 + i, "\n".join([prose(rng, 3)] * rng.randint(1, 9) + [prose(rng, 40)]), "de", "c") for i in range(9)]
    rows += [(400, prose(rng, 90), "xx", "alone"), (401, None, "en", "a"), (402, " ", "yy", None), (0, rows[0][1], "en", "a")]
    want = sorted(plain_verdicts(rows), key=str)
    assert verdicts(documents(rows)) == want and {k for _, k in want} == {True, False}


def test_no_number_of_rows_switches_verdicts(documents):
    """A cell of 49 rows and one of 50, by a row that stands twice: all others keep their verdicts."""
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(40, 300)), "en", "big") for i in range(200)]
    rows += [(500 + i, prose(rng, rng.randint(8, 60)).replace(" ", rng.choice([" ", " ", "# "])), "en", "small") for i in range(49)]
    assert set(verdicts(documents(rows))) == set(verdicts(documents([*rows, rows[-1]])))


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_outliers_go_and_clean_texts_stay(documents):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(60, 400)), "en", "big" if i % 3 else None) for i in range(240)]
    rows += [(500 + i, prose(rng, 80).replace(" ", "### "), "en", "big") for i in range(20)]
    rows += [(600 + i, "\n".join([prose(rng, 4)] + [prose(rng, 30)] * 1 + ["same line here ok " + "x"] * 9), "en", "big") for i in range(3)]
    rows += [(700, None, None, None), (701, "", "en", "big"), (702, "only three words", "en", "big"), (703, prose(rng, 50), "xx", "alone"), (0, rows[0][1], "en", None), (None, prose(rng, 99), "en", "big")]
    df = documents(rows).withColumns({"cell": F.lit("clash"), "kept": F.lit(1), "distance": F.lit(2)})
    got = {r.doc.doc_id: r for r in quality_rules.judge(df).collect()}
    assert all(got[i].kept for i in range(240)) and got[None].kept
    assert not any(got[500 + i].kept for i in range(20)) and not any(got[600 + i].kept for i in range(3))
    for i in (700, 701, 702):
        assert got[i].base_failed and not got[i].kept
    assert got[700].distance is None and got[700].stats.n_words == 0
    assert quality_rules.judge(df).count() == len(rows)


def test_empty_table_and_very_long_text(documents):
    assert quality_rules.judge(documents([])).count() == 0
    got = quality_rules.judge(documents([(1, "word " * 400_000), (2, "x" * 2_000_000)])).collect()
    assert {r.doc.doc_id: (r.stats.n_words, r.stats.n_repeat_words) for r in got} == {1: (400_000, 400_000), 2: (1, 0)}


def test_whole_table(spark, text_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{text_dir}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{text_dir}/labels.parquet").collect()}
    got = op4_quality_rules(spark, text_dir).collect()
    for r in got:
        n, *rest = plain_counts(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest[:4])
        assert r.base_failed == (n < 10 or 100 * r.n_repeat_words > 20 * n) and not (r.kept and r.base_failed)
    good = [r.kept for r in got if quality.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in got if quality.get(r.doc_id) == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.2 * len(bad)
