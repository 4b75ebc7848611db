import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prevalo.llm import chat
from prevalo.llm.queries import OP9_SQL, op9_chat

TURNS = "conv_id long, turn long, role string, text string"
LOG = "conv_id long, seq long, kind string, turn long, role string, text string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a>b\\"]), st.text(alphabet=st.sampled_from("\\<>/turn #:\nax é👍")))))
def test_parsing_gives_back_what_was_rendered(messages):
    text, loss = chat.render(messages)
    assert chat.parse(text) == messages
    assert chat.masked(text, loss) == "".join(t for r, t in messages if r == "assistant")
    assert text.count("</turn>\n") == len(messages)


def fold(spark, events):
    rows = chat.format_events(spark.createDataFrame(events, LOG)).collect()
    return {r.conv_id: chat.parse(r.formatted) for r in rows}


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 4, "delta", 1, None, "lo"), (1, 1, "message", 0, "user", "hi"), (1, 2, "start", 1, "assistant", None), (1, 3, "delta", 1, None, "hel"),
        (2, 1, "message", 0, "user", "a"), (2, 2, "message", 1, "assistant", "b"), (2, 3, "message", 2, "user", "c"), (2, 4, "edit", 0, None, "A"),
        (2, 5, "message", 1, "assistant", "B"),
        (3, 1, "message", 0, "user", "q"), (3, 2, "message", 1, "assistant", "bad"), (3, 3, "regenerate", 1, None, None), (3, 4, "delta", 1, None, "good"),
        (4, 1, "message", 0, "user", "x"), (4, 2, "delete", 0, None, None), (4, 3, "delta", 0, None, "late"), (4, 4, "unknown", 0, None, None),
        (None, 1, "message", None, None, None), (None, None, "message", 3, "user", "first in sequence"),
    ]
    assert fold(spark, events) == {
        1: [("user", "hi"), ("assistant", "hello")],
        2: [("user", "A"), ("assistant", "B")],
        3: [("user", "q"), ("assistant", "good")],
        4: [],
        None: [("", ""), ("user", "first in sequence")],
    }


def test_many_small_batches_and_a_long_conversation(spark):
    turns = [(i % 7, i, "assistant" if i % 2 else "user", f"<{i}>") for i in range(7000)] + [(50, i, "user", "z" * 300) for i in range(3000)]
    df = spark.createDataFrame(turns, TURNS).withColumns({"seq": F.lit("clash"), "kind": F.lit(0)})
    got = {r.conv_id: r for r in chat.format_events(chat.events_of_turns(df)).collect()}
    for k, r in got.items():
        mine = [(role, text) for c, _, role, text in turns if c == k]
        assert chat.parse(r.formatted) == mine
        assert chat.masked(r.formatted, [(x["start"], x["stop"]) for x in r.loss]) == "".join(t for x, t in mine if x == "assistant")
    assert len(got) == 8


def test_empty_table(spark):
    assert chat.format_events(spark.createDataFrame([], LOG)).count() == 0


def test_check_sql(spark, text_dir):
    engine = duckdb.connect()
    engine.execute(f"create view conversations as select * from '{text_dir}/conversations.parquet'")
    columns = "conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars"
    want = sorted(engine.execute(f"select {columns} from ({OP9_SQL})").fetchall())
    got = sorted(tuple(r) for r in op9_chat(spark, text_dir).select(*columns.split(", ")).collect())
    assert got == want and got[0][0] == -7 and got[0][1:2] == (2,)
