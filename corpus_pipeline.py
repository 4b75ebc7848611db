"""The corpus pipeline: language, near copies, repeated passages, mixing, tokens.

Every stage takes documents with null texts, languages, sources and ids, empty and very long texts, repeated rows and further columns,
also those with names that an operator uses inside, but for names that begin with two underscores: the rows of a stage's result are rows of its input, with all their columns. What
becomes of each case is stated in the operator's module. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prevalo.llm import language, mixing, repeats, simhash
from prevalo.llm.common import stage, table
from prevalo.llm.queries import token_digests
from prevalo.sources.staging import clear_staged, staging_scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found, with that language. Texts without letters go; if no document has
    a language to learn from, all stay as they are."""
    profiles = language.learn(docs)
    if not profiles[0]:
        return docs
    found = language.predict(docs, profiles, out="__guess").where(F.col("__guess.lang") != language.UNKNOWN)
    return found.select(*[F.col("__guess.lang").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: fingerprints of three-word shingles, linked at two or fewer bits."""
    return simhash.first_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller id has."""
    return repeats.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row for each document taken."""
    return token_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify),
    ("simhash", drop_near_copies),
    ("repeats", drop_repeats),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: Near copies, language profiles and token ids are not SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        with staging_scope(spark) as folder:
            kept = step(spark, docs, sf_dir)
        docs = stage(kept, name)
        clear_staged(spark, folder)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
