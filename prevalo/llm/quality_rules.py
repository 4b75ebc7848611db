"""Quality rules: robust multivariate outliers among the documents of a language and source.

A few counts of each whole text are made into a vector of shares and logarithms. For every cell
(language, source) the minimum covariance determinant gives the location and scatter of its
central rows: starting from medians and median deviations, concentration steps take the
``CENTRAL`` share of rows with the smallest Mahalanobis distances and estimate anew from them,
which lowers the determinant or leaves it. Steps go on until no cell's determinant changes by more than ``STILL`` of itself, ``STEPS`` at
most. A document whose squared distance is beyond ``CUT`` is
rejected. Every row of a cell takes part in every step; a step is two aggregations with partial sums, so a
cell may hold any share of the rows. Quantiles are Spark's mergeable sketches (relative error 1e-4).

Languages and the whole table have estimates of their own, from the same steps. A cell's estimate is drawn towards its
language's, and that towards the table's, as if ``PRIOR`` rows of the wider estimate had been added: with n rows of its own a cell
counts n / (n + PRIOR). No number of rows switches anything; a cell of one row is judged almost by its language, one of thousands by itself.

Most texts have no symbols and no repeated lines at all, and no covariance could be inverted there; so
``FLOOR``, the spread of each statistic that counts as ordinary anywhere, is added to the variances
(the regularised form of the estimator). Floors of shares are under a sixth of what they can reach, so each can reject a text by itself.

Cases: a null text has no words; texts without words aren't used for estimates and fail the base rules;
null languages and sources are cells of their own; repeated rows count each; an empty table gives an
empty result. Only the columns named in ``keep`` and ``cells`` are carried along, in structs of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prevalo.llm.common import python_workers, stage

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: What stands for no code point of its own: the second and further bytes of UTF-8.
FOLLOWING = bytes(range(0x80, 0xC0))
WINDOW = 5

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in (*STATS, "n_lines")])

#: The vector: logarithm of the length, mean word length, and square roots of the shares of symbols,
#: repeated lines and repeated words; and what spread of each is ordinary anywhere.
VECTOR = ("length", "word_length", "symbols", "dup_lines", "repeats")
FLOOR = (0.6, 0.5, 0.05, 0.15, 0.07)
CENTRAL, STEPS, STILL, PRIOR = 0.75, 12, 1e-6, 50.0
#: Parts that a cell's rows are dealt into where they meet the cell's estimate.
PARTS = 32
#: Scatter of a five-dimensional normal over that of its central three quarters.
CONSISTENT = 1.412
#: A squared distance that one of a million rows with five normal statistics exceeds.
CUT = 36.0


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside runs of ``window`` words that occur at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    run = ids
    size = 1
    while size < window:
        # Numbers of runs of ``size`` words, joined by overlap into numbers of longer ones.
        step = min(size, window - size)
        pair = run[:-step] * (int(run.max()) + 1) + run[step:]
        run = np.unique(pair, return_inverse=True)[1]
        size += step
    twice = np.bincount(run)[run] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def counts_of(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, SPACE + FOLLOWING)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def count(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """Add the struct ``out`` of the counts of each whole text."""
    python_workers(docs.sparkSession)

    @F.pandas_udf(COUNTS)
    def stats(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts_of(t) for t in texts], columns=COUNTS.names, dtype="int64")

    return docs.withColumn(out, stats(F.col(text).cast("binary")))


def base_failed(stats: str = "stats") -> Column:
    n, repeats = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 10) | (100 * repeats > 20 * n)


def vector(stats: str = "stats") -> list[Column]:
    c = {k: F.col(f"{stats}.{k}").cast("double") for k in COUNTS.names}
    words = F.greatest(c["n_words"], F.lit(1.0))
    return [
        F.log1p(c["n_words"]),
        c["word_chars"] / words,
        F.sqrt(c["n_symbols"] / F.greatest(c["word_chars"], F.lit(1.0))),
        F.sqrt(c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0))),
        F.sqrt(c["n_repeat_words"] / words),
    ]


PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i + 1)]


def _estimate() -> list[Column]:
    """The mean vector and the means of the products."""
    products = [F.avg(F.col(VECTOR[i]) * F.col(VECTOR[j])) for i, j in PAIRS]
    return [F.array(*map(F.avg, VECTOR)).alias("mean"), F.array(*products).alias("products")]


MATRIX = T.ArrayType(T.DoubleType())
ESTIMATE = T.StructType([T.StructField("mean", MATRIX), T.StructField("scatter", MATRIX)])


def _inverse_of(scatter: np.ndarray) -> np.ndarray:
    return np.linalg.inv(scatter + np.diag(np.square(FLOOR)))


@F.pandas_udf(MATRIX)
def _scatter(mean: pd.Series, products: pd.Series) -> pd.Series:
    """The scatter matrices of means and means of products, row by row."""
    out = []
    for m, p in zip(mean, products, strict=True):
        scatter = np.zeros((len(VECTOR), len(VECTOR)))
        for (i, j), x in zip(PAIRS, p, strict=True):
            scatter[i, j] = scatter[j, i] = CONSISTENT * (x - m[i] * m[j])
        out.append(scatter.ravel().tolist())
    return pd.Series(out, dtype=object)


@F.pandas_udf(MATRIX)
def _inverse(scatter: pd.Series) -> pd.Series:
    """The inverse of each scatter matrix with the floor."""
    k = len(VECTOR)
    return pd.Series([_inverse_of(np.reshape(s, (k, k))).ravel().tolist() for s in scatter], dtype=object)


@F.pandas_udf(T.DoubleType())
def _size(scatter: pd.Series) -> pd.Series:
    """The logarithm of the determinant of each scatter matrix with the floor."""
    k = len(VECTOR)
    return pd.Series([float(np.linalg.slogdet(np.reshape(s, (k, k)) + np.diag(np.square(FLOOR)))[1]) for s in scatter], dtype="float64")


def drawn(n: float, mean: np.ndarray, scatter: np.ndarray, wide_mean: np.ndarray, wide_scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scatter of n rows drawn towards a wider estimate of ``PRIOR`` rows. How far the two means are apart adds no
    scatter: a cell of few rows, of which one is an outlier, would excuse it."""
    own = n / (n + PRIOR)
    return own * mean + (1 - own) * wide_mean, own * scatter + (1 - own) * wide_scatter


@F.pandas_udf(ESTIMATE)
def _drawn(n: pd.Series, mean: pd.Series, scatter: pd.Series, wide_mean: pd.Series, wide_scatter: pd.Series) -> pd.DataFrame:
    k, out = len(VECTOR), []
    for row in zip(n, mean, scatter, wide_mean, wide_scatter, strict=True):
        m, s = drawn(row[0], np.asarray(row[1]), np.reshape(row[2], (k, k)), np.asarray(row[3]), np.reshape(row[4], (k, k)))
        out.append((m.tolist(), s.ravel().tolist()))
    return pd.DataFrame(out, columns=ESTIMATE.names)


def distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    d = [F.col(v) - F.col(mean)[i] for i, v in enumerate(VECTOR)]
    k = len(VECTOR)
    terms = [(d[i] * d[j] * F.col(inverse)[i * k + j]) * (1.0 if i == j else 2.0) for i, j in PAIRS]
    return sum(terms[1:], terms[0])


def _each_part(table: DataFrame) -> DataFrame:
    return table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def fit(rows: DataFrame, cell: str = "cell") -> DataFrame:
    """(cell, n, mean, scatter): rows and the robust estimate of each cell, by concentration steps over all its rows.

    Rows meet estimates by cell and part, so that totals by cell are partial sums first and a large cell is many tasks' work.
    """
    python_workers(rows.sparkSession)
    rows = stage(rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")), "rows")
    middle = [F.percentile_approx(v, 0.5, 10000).alias(f"m_{v}") for v in VECTOR]
    centre = rows.groupBy(cell).agg(*middle, F.count("*").alias("n"))
    spread = [F.percentile_approx(F.abs(F.col(v) - F.col(f"m_{v}")), 0.5, 10000).alias(f"s_{v}") for v in VECTOR]
    start = rows.join(_each_part(centre), [cell, "part"]).groupBy(cell, "n", *[f"m_{v}" for v in VECTOR]).agg(*spread)
    k = len(VECTOR)
    first = [F.pow(1.4826 * F.col(f"s_{v}"), 2) for v in VECTOR]
    scatter = F.array(*[first[i] if i == j else F.lit(0.0) for i in range(k) for j in range(k)])
    model = start.select(cell, "n", F.array(*[F.col(f"m_{v}") for v in VECTOR]).alias("mean"), scatter.alias("scatter"), F.lit(0.0).alias("change"))
    for step in range(STEPS + 1):
        model = stage(model.withColumns({"inverse": _inverse("scatter"), "size": _size("scatter")}), "mcd")
        if step == STEPS or (step > 1 and (model.agg(F.max("change")).first()[0] or 0.0) <= STILL):
            break
        near = rows.join(_each_part(model.select(cell, "mean", "inverse")), [cell, "part"]).withColumn("d", distance())
        edge = near.groupBy(cell).agg(F.percentile_approx("d", CENTRAL, 10000).alias("edge"))
        chosen = near.join(_each_part(edge), [cell, "part"]).where(F.col("d") <= F.col("edge"))
        new = chosen.groupBy(cell).agg(*_estimate()).select(cell, "mean", _scatter("mean", "products").alias("scatter"))
        before = model.select(cell, "n", F.col("size").alias("before"))
        model = new.join(before, cell).withColumn("change", F.abs(_size("scatter") - F.col("before"))).select(cell, "n", "mean", "scatter", "change")
    return model.select(cell, "n", "mean", "scatter")


def drawn_together(model: DataFrame, levels: int) -> DataFrame:
    """(cell, mean, inverse) of the narrowest cells, each estimate drawn towards the one above it. model: (level, cell, above, n, mean, scatter)."""
    wide = model.where("level = 0").select("cell", "mean", "scatter")
    for level in range(1, levels):
        above = wide.select(F.col("cell").alias("above"), F.col("mean").alias("wide_mean"), F.col("scatter").alias("wide_scatter"))
        own = model.where(F.col("level") == level).join(above, "above")
        wide = own.select("cell", _drawn("n", "mean", "scatter", "wide_mean", "wide_scatter").alias("e")).select("cell", "e.*")
        wide = stage(wide, "drawn")
    return wide.select("cell", "mean", _inverse("scatter").alias("inverse"))


def judge(docs: DataFrame, cells: tuple[str, ...] = ("lang", "source"), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc, stats, base_failed, distance, kept): ``keep`` as a struct, and the verdict. No words: no distance.

    ``cells`` go from wide to narrow.
    """
    # Texts are read once; all steps work on narrow rows.
    keys = [F.to_json(F.array(*[F.col(c).cast("string") for c in cells[:k]]).cast("array<string>"), {"ignoreNullFields": "false"}) for k in range(len(cells) + 1)]
    narrow = docs.select(F.struct(*keep).alias("doc"), F.array(*keys).alias("keys"), F.col("text").alias("text"))
    rows = count(narrow).drop("text")
    values = [v.alias(n) for n, v in zip(VECTOR, vector(), strict=True)]
    rows = stage(rows.select("doc", "keys", "stats", base_failed().alias("base_failed"), *values), "stats")
    known = rows.where("stats.n_words > 0")
    model = fit(known.select(F.explode("keys").alias("cell"), *VECTOR))
    places = known.select(F.posexplode(F.arrays_zip(F.col("keys").alias("cell"), F.concat(F.array(F.lit("")), "keys").alias("above")))).select(
        F.col("pos").alias("level"), "col.cell", "col.above"
    )
    places = places.where("cell IS NOT NULL").distinct()
    model = stage(places.join(model, "cell"), "cells")
    judged = rows.withColumn("cell", F.element_at("keys", -1)).join(drawn_together(model, len(cells) + 1), "cell", "left")
    judged = judged.withColumn("distance", F.when(F.col("stats.n_words") > 0, distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(False))
    return judged.select("doc", "stats", "base_failed", "distance", kept.alias("kept"))
