import corpus_pipeline

IDENTIFY = dict(corpus_pipeline.STAGES)["language"]
ENGLISH = "the weather in the north was cold and the people of the town stayed in their houses "
GERMAN = "das Wetter im Norden war kalt und die Leute der Stadt blieben in ihren Häusern "


def test_predictions_replace_labels_that_disagree(spark, documents):
    rows = [(i, f"{ENGLISH * 5}{i}", "en") for i in range(5)] + [(10 + i, f"{GERMAN * 5}{i}", "de") for i in range(5)]
    rows += [(20, GERMAN, "en"), (21, ENGLISH, None), (22, "123", "en")]
    got = IDENTIFY(spark, documents(rows), "")
    assert got.columns == documents(rows).columns
    want = {i: lang for i, _, lang in rows[:10]} | {20: "de", 21: "en"}
    assert {r.doc_id: r.lang for r in got.collect()} == want


def test_documents_stay_when_no_language_can_be_learned(spark, documents):
    rows = [(1, ENGLISH), (2, GERMAN), (3, None)]
    assert sorted(r.doc_id for r in IDENTIFY(spark, documents(rows), "").collect()) == [1, 2, 3]
