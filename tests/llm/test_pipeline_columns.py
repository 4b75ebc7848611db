"""Further columns, with names that operators use inside, go through all stages but the last with their rows."""

import corpus_pipeline
from pyspark.sql import functions as F

NAMES = ("size", "doc", "kept", "spans", "code", "fingerprint", "component_id", "root", "digest", "rows", "t", "own", "id", "block", "data", "taken", "copies", "u", "stats", "cell", "predicted", "n_bytes", "target", "null_text")


def test_clashing_columns_stay_with_their_rows(spark, documents):
    texts = ["the weather in the north was cold and wet all day", "der Hund und die Katze sind in der Küche", "only numbers 12 and words", None, "", "123"]
    rows = [(i, f"{texts[i % 6]} number {i} of many" if texts[i % 6] else texts[i % 6], ["en", "de", None][i % 3], ["a", None, "b"][i % 3]) for i in range(30)]
    docs = documents([*rows, rows[0], (None, "a text without an id but with words", "en", None)])
    docs = docs.withColumns({name: F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for name in NAMES})
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, "").collect(), docs.schema)
        assert docs.columns == columns, name
        kept = docs.collect()
        assert kept and all(r[n] == f"{n} of {'none' if r.doc_id is None else r.doc_id}" for r in kept for n in NAMES), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(kept)
