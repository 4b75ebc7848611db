"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events with a sequence number. They are partitioned by conversation,
sorted by sequence, and folded into final messages:

* ``message`` opens a message with all its text, ``start`` one whose text is streamed by ``delta`` events,
* ``edit`` replaces a message's text and, like every chat front end, drops the messages after it,
* ``regenerate`` empties a message (and drops those after it); new deltas follow,
* ``delete`` removes a message.

Events name their message by ``turn``. Messages are rendered in the order of their turns, with equal
turns in the order in which they were opened. The template marks each turn and escapes control strings in the texts,
so no text can forge a mark, and ``parse`` gives back exactly what was rendered:

    <turn assistant>
    text</turn>

``loss`` holds the spans of the formatted string, in code points, over which a model is trained: the
escaped texts of the assistant's messages, without the marks.

Cases: null text is empty text; a null role is the empty role; null conversation ids are one
conversation; null turns and sequences come first; repeated events each count; events for a message that isn't open
are ignored; a conversation whose messages are all deleted gives an empty string. An empty table
gives an empty result. Other columns are ignored. A conversation's messages are folded in one task, one
conversation at a time, since its formatted string is one value of one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prevalo.llm.common import python_workers

CLOSE = "</turn>\n"
#: The characters that the template gives a meaning.
CONTROL = re.compile(r"[\\<>#]")
MARK = re.compile(r"<turn ([^\\>]*(?:\\.[^\\>]*)*)>\n([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)
ASSISTANT = "assistant"

EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string"
FORMATTED = "conv_id long, formatted string, loss array<struct<start: int, stop: int>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
ARROW = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", SPANS)])

Message = tuple[str, str]


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(messages: list[Message]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans under the loss mask."""
    out, loss, at = [], [], 0
    for role, text in messages:
        head, body = f"<turn {escape(role)}>\n", escape(text)
        if role == ASSISTANT:
            loss.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), loss


def parse(formatted: str) -> list[Message]:
    """The messages of a formatted string."""
    out, at = [], 0
    while at < len(formatted):
        m = MARK.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def masked(formatted: str, loss: list[tuple[int, int]]) -> str:
    """What the loss mask covers, unescaped."""
    return "".join(unescape(formatted[a:b]) for a, b in loss)


class Fold:
    """The state of one conversation."""

    def __init__(self) -> None:
        self.open: dict[tuple[int, int], tuple[str, list[str]]] = {}
        self.last: dict[int | None, tuple[int, int]] = {}
        self.opened = 0

    def apply(self, kind: str | None, turn: int | None, role: str | None, text: str | None) -> None:
        text = text or ""
        if kind in ("message", "start"):
            place = (-(1 << 63) if turn is None else turn, self.opened)
            self.opened += 1
            self.open[place], self.last[turn] = (role or "", [text]), place
            return
        place = self.last.get(turn)
        if place not in self.open:
            return
        if kind == "delta":
            self.open[place][1].append(text)
        elif kind in ("edit", "regenerate"):
            self.open[place] = (self.open[place][0], [text] if kind == "edit" else [])
            for later in [p for p in self.open if p > place]:
                del self.open[later]
        elif kind == "delete":
            del self.open[place]

    def messages(self) -> list[Message]:
        return [(role, "".join(parts)) for _, (role, parts) in sorted(self.open.items())]


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and sequence; the state of one conversation is held."""
    state, current = None, None

    def done() -> dict:
        text, loss = render(state.messages())
        return {"conv_id": current, "formatted": text, "loss": [{"start": a, "stop": b} for a, b in loss]}

    for batch in batches:
        rows = []
        values = (batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text"))
        for conv, *event in zip(*values, strict=True):
            if state is None or conv != current:
                if state is not None:
                    rows.append(done())
                state, current = Fold(), conv
            state.apply(*event)
        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
    if state is not None:
        yield pa.RecordBatch.from_pylist([done()], schema=ARROW)


def format_events(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) for each conversation of an event log (``EVENTS``)."""
    python_workers(events.sparkSession)
    log = events.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in EVENTS.split(", ")])
    # Sequence numbers may repeat; the rest of the event then decides.
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "turn", "kind", "role", "text")
    return log.mapInArrow(_formatted, FORMATTED)


def events_of_turns(turns: DataFrame) -> DataFrame:
    """The log of conversations stored as one row for each turn: every row is one message event."""
    return turns.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")
