import random
import re

import numpy as np
import pytest
from prevalo.llm import decontamination
from prevalo.llm.decontamination import WINDOW, Filter, decontaminate, shingle_keys, word_hashes
from prevalo.llm.words import word_lists

from tests.llm.test_search_queries import same_as_duckdb

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    """Every window of every item against every place of every document."""
    windows = {}
    for item, text in items:
        words = plain_words(text)
        size = min(WINDOW, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if names := windows.get(tuple(words[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= names
        out.append((doc, len(words), len(hit), sorted(found)))
    return sorted(out, key=str)


def got(spark, documents, docs, items, **more):
    found = decontaminate(documents(docs), spark.createDataFrame(items, ITEMS), **more).collect()
    assert all(sum(s.stop - s.start for s in r.spans) >= r.n_hit for r in found)
    return sorted(((r.doc.doc_id, r.n_words, r.n_hit, r["items"]) for r in found), key=str)


def test_against_brute_force(spark, documents):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["Été", "日本", "A1"]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, say(rng.choice([1, 2, 4, 5, 6, 9, 10, 11, 25, 40]))) for i in range(40)]
    items = [(i, t) for i, t in items if len(t.split()) > 2] + [(100, "alone"), (101, "two words"), (None, say(12)), (102, None), (103, "?! -")]
    items += [(3, say(15)), (104, items[4][1]), (105, items[4][1])]
    docs = []
    for i in range(120):
        text = say(rng.choice([0, 1, 5, 12, 60, 300]))
        for _ in range(rng.choice([0, 1, 3])):
            part = rng.choice([t for _, t in items if t]).split()
            a = rng.randrange(len(part))
            text += rng.choice([" ", ", ", "\n-"]) + rng.choice([str, str.upper])(" ".join(part[a:]) or "") + " " + say(3)
        docs.append((i, text))
    docs += [(500, None), (501, ""), (502, "...!"), (7, docs[7][1]), (None, docs[9][1]), (503, "ALONE"), (504, "two, words! two_words"), (505, items[0][1] + " " + items[0][1])]
    assert got(spark, documents, docs, items) == plain(docs, items)


def test_hot_passages_are_searched_once(spark, documents):
    passage = " ".join(f"q{i}" for i in range(30))
    items = [(i, passage if i < 20 else f"other {i} " + passage) for i in range(40)]
    docs = [(i, f"before {i} {passage} after" if i % 3 == 0 else f"clean {i} text") for i in range(300)]
    assert got(spark, documents, docs, items) == plain(docs, items)


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(1)
    words = [f"w{rng.randrange(50)}".encode() for _ in range(5000)]
    window = words[2990:3000]
    monkeypatch.setattr(decontamination, "PART", 100)
    monkeypatch.setattr(decontamination, "word_lists", lambda text: word_lists(text, 1000))
    keys = shingle_keys(word_hashes(window), 5)
    bits = 16
    table = np.zeros(1 << (bits - 6), np.uint64)
    for at in decontamination.places(keys, bits):
        np.bitwise_or.at(table, (at >> np.uint64(6)).astype(int), np.uint64(1) << (at & np.uint64(63)))
    count, found = Filter(table, bits, {5: 6}).passages(b" ".join(words))
    assert count == 5000
    want = [i for i in range(4991) if words[i : i + 10] == window]
    assert {s + k for p, starts in found.items() for s in starts for k in range(len(p.split()) - 9) if p.split()[k : k + 10] == window} == set(want)


@pytest.mark.parametrize("size", [1000, 300_000])
def test_words_of_pieces_are_the_words_of_the_text(size):
    text = "Ab,c9 é_ß 日本 x\ty " * 20_000
    assert [w.decode() for part in word_lists(text.encode(), size) for w in part] == plain_words(text)


def test_empty_tables(spark, documents):
    docs = [(1, "some words of a text"), (2, None)]
    assert got(spark, documents, docs, []) == [(1, 5, 0, []), (2, 0, 0, [])]
    assert got(spark, documents, [], [(1, "a b c")]) == []
    assert got(spark, documents, docs, [(1, None), (2, " .")]) == [(1, 5, 0, []), (2, 0, 0, [])]


def test_clashing_columns_and_the_text_of_spans(spark, documents):
    docs = documents([(1, "x y a b c d e f g h i j z")]).withColumnRenamed("lang", "spans").withColumnRenamed("source", "row")
    found = decontaminate(docs, spark.createDataFrame([(9, "a b c d e f g h i j")], ITEMS), keep=("doc_id", "spans", "row", "n_chars")).first()
    assert found.doc.asDict() == {"doc_id": 1, "spans": None, "row": None, "n_chars": 25}
    assert [(s.start, s.stop) for s in found.spans] == [(2, 12)]


def test_query_against_sql(spark, text_dir):
    same_as_duckdb(spark, text_dir, "op11_decontamination")
