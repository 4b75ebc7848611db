import hashlib
from collections import Counter

import corpus_pipeline
from prevalo.llm.queries import tokenizer_path
from tests.llm.test_mixing import plain_mix
from tests.llm.test_repeats import plain_kept
from tests.llm.test_simhash import plain_classes, plain_fingerprint
from tokenizers import Tokenizer

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_against_the_plain_ones(spark, text_dir):
    docs = spark.read.parquet(f"{text_dir}/documents.parquet")
    columns, now = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert list(STAGES) == ["language", "simhash", "repeats", "mixing", "bpe"]

    docs = spark.createDataFrame(STAGES["language"](spark, docs, text_dir).collect(), docs.schema)
    assert docs.columns == columns and set(docs.collect()) == {r for r in now.values() if any(c.isalpha() for c in r.text)}

    rows = docs.collect()
    classes = plain_classes([(r.doc_id, plain_fingerprint(r.text)) for r in rows])
    docs = spark.createDataFrame(STAGES["simhash"](spark, docs, text_dir).collect(), docs.schema)
    assert sorted(docs.collect()) == sorted(r for r, c in zip(rows, classes, strict=True) if r.doc_id == c)

    rows = docs.collect()
    left = {r.doc_id: kept[0].decode("utf-8", "ignore") for r, kept in zip(rows, plain_kept([(r.doc_id, r.text) for r in rows]), strict=True)}
    docs = spark.createDataFrame(STAGES["repeats"](spark, docs, text_dir).collect(), docs.schema)
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in left.items() if t.split()}

    rows = docs.collect()
    want = {i: taken // size for i, (size, _, _, taken) in plain_mix([(r.doc_id, r.text, r.lang, r.source) for r in rows]).items()}
    docs = spark.createDataFrame(STAGES["mixing"](spark, docs, text_dir).collect(), docs.schema)
    assert Counter(r.doc_id for r in docs.collect()) == +Counter(want) and docs.columns == columns

    library = Tokenizer.from_file(tokenizer_path())
    got = Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in STAGES["bpe"](spark, docs, text_dir).collect())
    assert got == Counter(
        (r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids), hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect()
    )


def test_run_gives_the_last_stage(spark, text_dir):
    assert corpus_pipeline.run(spark, text_dir).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_documents(spark, documents, text_dir):
    docs = documents([])
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, text_dir)
    assert docs.count() == 0
