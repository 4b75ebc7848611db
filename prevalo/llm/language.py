"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (n = 1 to 3) of a language, by falling
frequency. A document's own most frequent n-grams are compared to each profile by the out-of-place
distance: the sum over them of how far an n-gram's rank is from its rank in the profile, and the
profile's length for one that isn't in it. The nearest profile wins.

Letters only count: texts are lower-cased and cut into words of letters, each with a blank at either
end. Up to three letters fit one 64-bit number, so n-grams are counted as numbers, exactly.

Profiles are counted over all training documents. Workers count words first and then n-grams of
distinct words, flush partial counts when a table of theirs is full, and Spark adds up the parts, so no task
holds a language. What reaches the driver and is broadcast is ``PROFILE`` n-grams for each of at most
``MOST_LANGUAGES`` languages.

Cases: a null text, and one without a letter, is ``und`` with score 0; with no training documents all
are ``und``; null languages aren't learned; ties in frequency go to the smaller n-gram, ties in distance to
the language first in code-point order; repeated rows count once each and get a row each. An empty table gives an empty
result. Other columns stay; the result is one struct.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prevalo.llm.common import give_back, python_workers

#: N-grams in a profile, and most frequent n-grams of a document that are compared.
PROFILE, OWN = 1500, 400
MOST_LANGUAGES = 1000
#: Parts in which a language's n-grams are ranked first.
PARTS = 64
#: Distinct words a worker holds while it counts.
HELD = 30_000
UNKNOWN = "und"

#: Letters, and numerals that are not decimal digits, which ``words_of`` takes out.
WORDS = re.compile(r"[^\W\d_]+")
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

Profiles = tuple[list[str], np.ndarray, np.ndarray]


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L), in lower case."""
    out: list[str] = []
    for word in WORDS.findall(text.lower()):
        if word.isalpha():
            out.append(word)
        else:
            out += "".join(c if c.isalpha() else " " for c in word).split()
    return out


def grams(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of words as numbers, and the place of the word that each is from (by its blank in front)."""
    text = " " + "  ".join(words) + " "
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    blank = c == 32
    start = blank.copy()
    start[1:] &= blank[:-1]
    start[0] = True
    word = np.cumsum(start) - 1
    two = (c[:-1] << 21 | c[1:])[~(blank[:-1] & blank[1:])]
    inner = ~blank[1:-1]
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[inner]
    places = (word[~blank], word[:-1][~(blank[:-1] & blank[1:])], word[1:-1][inner])
    return np.concatenate([c[~blank], two, three]), np.concatenate(places)


def ranked(values: np.ndarray, most: int) -> np.ndarray:
    """The most frequent values, by falling count, then by value."""
    found, counts = np.unique(values, return_counts=True)
    if len(found) > most:
        # All that may be among the first; ties at the edge are kept for the order by value.
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        found, counts = found[counts >= least], counts[counts >= least]
    return found[np.lexsort((found, -counts))][:most]


def _counted(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, words in held.items():
            number, place = grams(words)
            weight = np.fromiter(words.values(), np.int64, len(words))[place]
            found, back = np.unique(number, return_inverse=True)
            total = np.bincount(back, weight).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found), pa.array(total)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > most:
                yield from flush()
        give_back()
    yield from flush()


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", length: int = PROFILE) -> Profiles:
    """(languages, n-grams, ranks): a profile of each language, all profiles' n-grams in one sorted array,
    and the rank of each n-gram in each profile (``length`` where it has none)."""
    python_workers(docs.sparkSession)
    known = docs.select(lang, text).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = known.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # First in parts, so that no task sorts all n-grams of a language.
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(PARTS))).orderBy(F.desc("n"), "gram")
    counts = counts.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= length)
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length).withColumn("rank", F.col("rank") - 1)
    # Bounded by the number of languages; one more than allowed is enough to tell.
    rows = top.select("lang", "gram", "rank").limit((MOST_LANGUAGES + 1) * length).toPandas()
    languages = sorted(rows["lang"].unique())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    vocabulary = np.unique(rows["gram"].to_numpy(np.int64))
    ranks = np.full((len(languages), len(vocabulary)), length, np.int32)
    ranks[np.searchsorted(languages, rows["lang"]), np.searchsorted(vocabulary, rows["gram"])] = rows["rank"]
    return languages, vocabulary, ranks


def nearest(text: str | None, profiles: Profiles, length: int = PROFILE, own: int = OWN) -> tuple[str, float]:
    """Language and score of a text. The score is one minus the distance as a share of the greatest possible."""
    languages, vocabulary, ranks = profiles
    words = words_of(text) if text else []
    if not words or not languages:
        return UNKNOWN, 0.0
    first = ranked(grams(words)[0], own)
    at = np.minimum(np.searchsorted(vocabulary, first), len(vocabulary) - 1)
    there = vocabulary[at] == first
    rank = np.where(there, ranks[:, at], length)
    distance = np.where(rank < length, np.abs(rank - np.arange(len(first))), length).sum(axis=1)
    best = int(distance.argmin())
    return languages[best], float(1 - distance[best] / (length * len(first)))


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", out: str = "predicted") -> DataFrame:
    """Add the struct ``out`` (lang, score). Whole texts are used."""
    spark = docs.sparkSession
    python_workers(spark)
    shared = spark.sparkContext.broadcast(profiles)

    @F.pandas_udf(RESULT)
    def guess(texts: pd.Series) -> pd.DataFrame:
        found = [nearest(t, shared.value) for t in texts]
        give_back()
        return pd.DataFrame(found, columns=RESULT.names)

    # Not to be repeated by Catalyst for a filter on its result.
    return docs.withColumn(out, guess.asNondeterministic()(F.col(text)))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the CRC of the id, as text, leaves this remainder. Null ids are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
