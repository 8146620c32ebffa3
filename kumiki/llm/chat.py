"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations in the order of ``seq``:

- ``delta`` appends its text to a message (and begins the message, with its role, if it isn't there);
- ``edit`` replaces the text of a message, and its role where the event has one;
- ``regenerate`` drops what a message held and all later messages of the conversation; later events build them anew.

An event counts for a message only if it comes after the last ``regenerate`` of that message or an earlier one, which
is a running maximum over the conversation's messages. Messages are then folded each by itself, so a conversation of
any length is split by message. Each message is rendered as one segment of the conversation's text:

    ### role: escaped text </turn>\\n

A backslash, ``###`` and ``</turn>`` inside a role or text are escaped by a backslash before their first character, so
a control string never stands in a text unescaped, and unescaping is exact. The loss mask is the span of the escaped
text of an assistant's segment, in code points.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kumiki.llm.shared import small_batches

EVENTS = "conv_id long, seq long, kind string, turn long, nth int, role string, text string"
CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)|:(?= )")
HEAD, END = "### ", " </turn>\n"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


#: Events of a turn in a log: drafts come before this place among them, the final text from it on.
FINAL, SLOTS = 3, 8


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """A log that folds to a table of finished turns (conv_id, turn, role, text).

    Rows that repeat a turn are messages of their own, in the order of role and text. By a hash of its key a message is
    streamed in three deltas, begun as a draft that an edit replaces and deltas complete, or regenerated after a draft.
    """
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = conversations.select("conv_id", "turn", nth.alias("nth"), "role", F.coalesce("text", F.lit("")).alias("text"))
    way = F.pmod(F.xxhash64("conv_id", "turn", "nth"), F.lit(3))
    third = F.ceil(F.char_length("text") / 3).cast("int")

    def event(at: int, kind: str, text, role=None):
        return F.struct(
            F.lit(at).alias("at"), F.lit(kind).alias("kind"), text.alias("text"), (F.col("role") if role is None else role).alias("role")
        )

    none = F.lit(None).cast("string")
    parts = [F.substr("text", F.lit(1) + third * i, third) for i in range(2)] + [F.substr("text", F.lit(1) + third * 2)]
    deltas = [event(FINAL + i, "delta", p) for i, p in enumerate(parts)]
    draft = event(0, "delta", F.concat(F.lit("draft of "), F.substr("text", F.lit(1), F.lit(20))))
    edited = [draft, event(FINAL, "edit", parts[0], none), *deltas[1:]]
    again = [draft, event(1, "edit", F.lit("not yet")), event(2, "regenerate", none), *deltas]
    log = F.when(way == 0, F.array(*deltas)).when(way == 1, F.array(*edited)).otherwise(F.array(*again))
    first = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 59))) * SLOTS
    return rows.withColumn("e", F.explode(log)).select(
        "conv_id", (first + F.col("e.at")).alias("seq"), "e.kind", "turn", "nth", "e.role", "e.text"
    )


def live_events(events: DataFrame) -> DataFrame:
    """Events that no regeneration has undone."""
    events = events.select("conv_id", "seq", "kind", "turn", "nth", "role", "text")
    again = events.filter("kind = 'regenerate'").select("conv_id", "turn", "nth", "seq")
    if again.isEmpty():
        return events
    some = events.join(again.select("conv_id").distinct(), "conv_id", "left_semi")
    marks = some.groupBy("conv_id", "turn", "nth").agg(
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("own")
    )
    # Messages in order, each with the last regeneration of itself or an earlier one.
    order = Window.partitionBy("conv_id").orderBy("turn", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = marks.select("conv_id", "turn", "nth", F.max("own").over(order).alias("reset")).filter("reset IS NOT NULL")
    marks = marks.withColumnsRenamed({c: f"__{c}" for c in ("conv_id", "turn", "nth")})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("conv_id", "turn", "nth")]
    return (
        events.join(marks, same[0] & same[1] & same[2], "left")
        .filter((F.col("kind") != "regenerate") & (F.col("reset").isNull() | (F.col("seq") > F.col("reset"))))
        .drop("reset", "__conv_id", "__turn", "__nth")
    )


def fold(batches, names):
    """Messages of a partition sorted by message and seq; state passes from batch to batch, one message at a time."""
    key, role, parts = None, None, []

    def done(out):
        if key is not None:
            out.append((*key, role or "", "".join(parts)))

    for batch in batches:
        out: list[tuple] = []
        for conv, _, kind, turn, nth, who, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (conv, turn, nth) != key:
                done(out)
                key, role, parts = (conv, turn, nth), who, []
            if kind == "edit":
                parts = []
                role = who or role
            role = role or who
            parts.append(text or "")
        if out:
            yield as_batch(out, names)
    out = []
    done(out)
    if out:
        yield as_batch(out, names)


def as_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names)


KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]


def messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, nth, role, text of the final messages."""
    names = ["conv_id", "turn", "nth", "role", "text"]
    log = live_events(events)
    dealt = log.repartition("conv_id", "turn", "nth").sortWithinPartitions("conv_id", "turn", "nth", "seq", "kind", "text")
    return dealt.mapInArrow(lambda it: fold(it, names), "conv_id long, turn long, nth int, role string, text string")


def render_rows(batches, names):
    for batch in batches:
        segments, begins, ends = [], [], []
        for role, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            head, body = f"### {escape(role)}: ", escape(text)
            segments.append(f"{head}{body} </turn>\n")
            masked = role == "assistant"
            begins.append(len(head) if masked else None)
            ends.append(len(head) + len(body) if masked else None)
        cols = [*batch.columns[:3], pa.array(segments, pa.string()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())]
        yield pa.record_batch(cols, names)


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, turn, nth, segment, loss_begin, loss_end; a conversation's text is its segments in order.

    events has the columns of EVENTS. Null texts and roles count as empty, a null conv_id or turn is a value like any
    other, and comes first. Events of equal seq apply in the order of kind and text. Columns beyond those of EVENTS are
    not looked at. An empty log gives an empty result.
    """
    small_batches(events.sparkSession)
    names = ["conv_id", "turn", "nth", "segment", "loss_begin", "loss_end"]
    schema = "conv_id long, turn long, nth int, segment string, loss_begin long, loss_end long"
    return messages(events).mapInArrow(lambda it: render_rows(it, names), schema)


def unescaped(text: str, mark: str, begin: int, end: int) -> int:
    """The first place of mark in text[begin:end] that no backslash escapes, or -1."""
    at = text.find(mark, begin, end)
    while at >= 0:
        back = at
        while back > begin and text[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            return at
        at = text.find(mark, at + 1, end)
    return -1


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text of a rendered segment, by a scan for its control strings."""
    begin, end = len(HEAD), len(segment) - len(END)
    colon = unescaped(segment, ": ", begin, end + 1) if segment.startswith(HEAD) and segment.endswith(END) else -1
    body = colon + 2
    if colon < 0 or body > end or any(unescaped(segment, mark, body, end) >= 0 for mark in ("###", "</turn>")):
        raise ValueError(f"no segment: {segment[:80]!r}")
    return unescape(segment[begin:colon]), unescape(segment[body:end])


def digest_rows(batches, names):
    """A row for each conversation of a sorted partition; of a conversation only running digests are held."""
    conv, held = None, False
    n = loss = chars = 0
    turns, masked = hashlib.sha256(), hashlib.sha256()
    for batch in batches:
        out = []
        for c, segment, b, e in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
            if not held or c != conv:
                if held:
                    out.append((conv, n, turns.hexdigest(), loss, masked.hexdigest(), chars))
                conv, held, n, loss, chars = c, True, 0, 0, 0
                turns, masked = hashlib.sha256(), hashlib.sha256()
            role, text = parse_segment(segment)
            turns.update(f"{role}\n{text}\n".encode())
            n += 1
            chars += len(segment)
            if b is not None:
                own = unescape(segment[b:e])
                loss += len(own)
                masked.update(own.encode())
        if out:
            yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], schema=names)
    if held:
        row = (conv, n, turns.hexdigest(), loss, masked.hexdigest(), chars)
        yield pa.record_batch([pa.array([x]) for x in row], schema=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, parsed from its segments: counts and digests of its turns and of its loss text."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    target = pa.schema(list(zip(names, kinds, strict=True)))
    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "nth")
        .mapInArrow(
            lambda it: digest_rows(it, target),
            "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
        )
    )
