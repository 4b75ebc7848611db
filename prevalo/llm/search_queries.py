"""The registered queries over benchmark items and hard negatives, and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prevalo.llm import decontamination, negatives, ranking
from prevalo.llm.common import table


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    items = F.size("items").cast("bigint").alias("n_items")
    return found.select("doc.doc_id", "n_words", "n_hit", items, digest, (F.col("n_hit") > 0).alias("contaminated"))


OP11_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
item_places AS (
  SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM item_words WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item, m, array_to_string(w[p:p + m - 1], ' ') AS run FROM item_places),
lengths AS (SELECT DISTINCT m FROM item_windows),
doc_places AS (
  SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS p FROM doc_words, lengths WHERE len(w) >= m),
doc_windows AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS run FROM doc_places),
met AS (SELECT d.doc_id, d.m, d.p, i.item FROM doc_windows d JOIN item_windows i ON d.run = i.run AND d.m = i.m),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + m)) AS q FROM met) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved, by_score=True)


OP12_SQL = r"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
heads AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 6),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM usable a JOIN usable r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT s.anchor_id, s.vec_id AS positive_id, s.score AS positive_score FROM scored s JOIN heads h ON s.vec_id = h.vec_id WHERE s.same
  QUALIFY row_number() OVER (PARTITION BY s.anchor_id ORDER BY s.vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER o)::INT AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
WHERE 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW o AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER o <= 3
"""


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM doc_terms GROUP BY doc_id, term),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
item_terms AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT item_id, term, count(*)::BIGINT AS repeats FROM item_terms GROUP BY item_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
scored AS (
  SELECT a.item_id, t.doc_id, sum(a.repeats * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 75 + ((75 * s.n * o.docs) // o.terms)))))::BIGINT AS score
  FROM asked a JOIN tf t ON a.term = t.term JOIN weights w ON w.term = a.term JOIN sizes s ON s.doc_id = t.doc_id, totals o
  GROUP BY a.item_id, t.doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

SEARCH_QUERIES = {"op11_decontamination": op11_decontamination, "op12_negatives": op12_negatives, "op13_ranking": op13_ranking}
SEARCH_SQL = {"op11_decontamination": OP11_SQL, "op12_negatives": OP12_SQL, "op13_ranking": OP13_SQL}
