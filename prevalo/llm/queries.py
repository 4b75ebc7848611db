"""The registered queries of this subpackage and their check SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prevalo.llm import bpe, chat, language, mixing, neighbours, quality_model, quality_rules, repeats, sharding, simhash
from prevalo.llm.common import python_workers, table
from prevalo.llm.search_queries import SEARCH_QUERIES, SEARCH_SQL


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def token_digests(docs: DataFrame) -> DataFrame:
    return bpe.round_trip(docs.select("doc_id", "text"), tokenizer_path()).select("doc_id", "bpe.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    bits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    return classes.select("doc.doc_id", bits, "component_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    stats = [F.col(f"stats.{c}") for c in quality_rules.STATS]
    return judged.select("doc.doc_id", *stats, "base_failed", "kept")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"), 4, 2)
    profiles = language.learn(docs.where(~out))
    guessed = language.predict(docs.select("doc_id", "text", out.alias("held_out")), profiles)
    return guessed.select("doc_id", "held_out", F.col("predicted.lang").alias("lang_pred"), "predicted.score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.sized(table(spark, sf_dir, "documents"))
    taken = mixing.with_copies(rows, mixing.mixing_plan(rows))
    return taken.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
    1.5::DOUBLE * sum(source_size) OVER () AS due FROM totals),
filled AS (
  SELECT *, 2 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead
  FROM weighed WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
stopped AS (SELECT *, (2 * source_size * ahead)::DOUBLE <= (due - before) * weight AS stops FROM filled),
targets AS (
  SELECT source, source_size, CASE WHEN stops THEN 2.0::DOUBLE * source_size ELSE
    (due - coalesce(sum(2 * source_size) FILTER (stops) OVER (), 0)::DOUBLE) * weight
      / (sum(weight) FILTER (NOT stops) OVER ())::DOUBLE END AS target
  FROM stopped),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
plan AS (
  SELECT *, floor(rate) AS whole, rate - floor(rate) AS f, target - floor(rate) * source_size AS left_due FROM rates),
ranked AS (
  SELECT s.doc_id, s.size, p.*, CASE WHEN f > 0 THEN (u / (1 - u)) * ((1 - f) / f) END AS x
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY x, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS middle FROM ranked)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN f > 0 AND middle <= left_due THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    field = quality_model.learn(docs, labels.where(~language.held_out(F.col("doc_id"), 5, 0)))
    scored = quality_model.score(docs.withColumn("held_out", language.held_out(F.col("doc_id"), 5, 0)), field)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", crc.alias("text_crc32"))
    return sharding.shard(docs, keep=("doc_id", "text_crc32")).select(
        "doc.doc_id", "placed.size", "doc.text_crc32", F.lit("bytes").alias("law"), "placed.shard", "placed.slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turns = chat.parse(text)
            learnt = chat.masked(text, [(x["start"], x["stop"]) for x in loss])
            digest = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest()
            rows.append((conv, len(turns), digest, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
        columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    formatted = chat.format_events(chat.events_of_turns(turns.union(extra)))
    python_workers(spark)
    return formatted.mapInArrow(_read_back, DIGESTS)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return left.select(
        "doc.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(16 + length(role) + length(regexp_replace(role, '[^\\<>#]', '', 'g'))
    + length(text) + length(regexp_replace(text, '[^\\<>#]', '', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

LLM_QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_neighbours": op2_neighbours,
    "op3_bpe": op3_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_language": op5_language,
    "op6_mixing": op6_mixing,
    "op7_quality_model": op7_quality_model,
    "op8_sharding": op8_sharding,
    "op9_chat": op9_chat,
    "op10_repeats": op10_repeats,
    **SEARCH_QUERIES,
}
LLM_SQL = {"op6_mixing": OP6_SQL, "op9_chat": OP9_SQL, **SEARCH_SQL}
