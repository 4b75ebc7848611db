from prevalo.llm import simhash


def test_classes_that_share_their_smallest_id_keep_a_document_each(documents):
    a, b = "one text about the sea and the ships on it", "another one on the making of bread and cheese"
    rows = [(1, a), (1, b), (2, a), (3, b), (3, b), (4, a)]
    assert sorted((r.doc_id, r.text) for r in simhash.first_of_each(documents(rows)).collect()) == sorted([(1, a), (1, b)])
