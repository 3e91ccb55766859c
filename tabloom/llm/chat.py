"""Chat formatting by event-sourced reconstruction.

The log of a conversation holds events on its messages: ``open`` (a message with its
first text), ``delta`` (text streamed on to it), ``edit`` (a new text in place of it)
and ``regenerate`` (its text is withdrawn and begins anew).  Logs are partitioned by
conversation, sorted by message and sequence, and folded as a stream, so that a task
holds one message at a time.  Finished messages are rendered into parts of bounded
size, each with the spans that carry loss; the parts of a conversation joined in order
are its formatted text, and each part can be read back alone.

Control strings inside a text get one more backslash behind their first character, and
lose one when read back, so that the template's marks stay unique.

Defined results: null texts, roles and kinds count as empty, empty and ``open``.  Events
of a message nobody opened open it.  Rows that repeat are messages of their own.  A null
conversation id is a conversation.  An empty log gives an empty result.  One very long
conversation is one stream, because its digest is, but never held as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.ship import ship

# The marks of the template.
BEGIN, END = "<s>", "</s>"
OPEN, CLOSE = "[INST]", "[/INST]"
ROLE, END_ROLE = "[ROLE]", "[/ROLE]"
# Roles whose texts a model learns to write.
LEARNED = "assistant"
# Characters after which a part ends, with the message that reached them.
PART_CHARS = 1_000_000
# Code points of one streamed delta in the log derived from a finished table.
DELTA_CHARS = 200

_CONTROL = r"/?s>|/?INST\]|/?ROLE\]"
_PLAIN = re.compile(rf"([<\[])(\\*)(?={_CONTROL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_CONTROL})")
_TURN = re.compile(
    rf"{re.escape(BEGIN)}{re.escape(ROLE)}(.*?){re.escape(END_ROLE)}"
    rf"(?:{re.escape(OPEN)}(.*?){re.escape(CLOSE)}|(.*?)){re.escape(END)}",
    re.DOTALL,
)

PARTS = "conv_id long, part int, text string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """One turn, and the span of its text if it carries loss."""
    head = f"{BEGIN}{ROLE}{escape(role)}{END_ROLE}"
    if role == LEARNED:
        body = escape(text)
        return f"{head}{body}{END}", (len(head), len(head) + len(body))
    return f"{head}{OPEN}{escape(text)}{CLOSE}{END}", None


def turns(part: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted part."""
    at = 0
    for m in _TURN.finditer(part):
        if m.start() != at:
            raise ValueError("text between turns")
        at = m.end()
        yield unescape(m[1]), unescape(m[2] if m[2] is not None else m[3])
    if at != len(part):
        raise ValueError("text after the last turn")


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[name].to_pylist() for name in names))


def _ordered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key, *order)


def formatted(log: DataFrame, order: list[str]) -> DataFrame:
    """``conv_id, part, text, loss`` of a log ``conv_id, <order>, seq, kind, role, text``.

    ``order`` names the columns that number a conversation's messages and tell them
    apart; ``loss`` holds code point spans of the part's text.
    """
    ship(log.sparkSession)
    log = log.select("conv_id", F.struct(*order).alias("message"), "seq", "kind", "role", "text")
    # Messages are told apart by all of their numbering columns, in binary form.
    log = log.withColumn("key", F.to_json("message"))

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for conv, key, kind, role, text in _rows(batches, ["conv_id", "key", "kind", "role", "text"]):
            kind, text = kind or "open", text or ""
            if held is None or held[0] != (conv, key):
                if held is not None:
                    yield held[0][0], held[1], "".join(held[2])
                held = [(conv, key), role or "", [text]]
            elif kind == "delta":
                held[2].append(text)
            else:
                held[1] = role or held[1]
                held[2] = [text]
        if held is not None:
            yield held[0][0], held[1], "".join(held[2])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(conv, number, pieces, spans) -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return pa.record_batch(
                {
                    "conv_id": pa.array([conv], pa.int64()),
                    "part": pa.array([number], pa.int32()),
                    "text": pa.array(["".join(pieces)], pa.string()),
                    "loss": pa.array([[{"start": s, "end": e} for s, e in spans]], kind),
                }
            )

        now, number, pieces, spans, size = None, 0, [], [], 0
        started = False
        ready: list[pa.RecordBatch] = []
        weight = 0
        for conv, role, text in messages(batches):
            if started and (conv != now or size >= PART_CHARS):
                ready.append(part(now, number, pieces, spans))
                weight += size
                number = number + 1 if conv == now else 0
                pieces, spans, size = [], [], 0
                if len(ready) >= 1000 or weight >= PART_CHARS:
                    yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                    ready, weight = [], 0
            started, now = True, conv
            turn, span = render(role, text)
            if span:
                spans.append((span[0] + size, span[1] + size))
            pieces.append(turn)
            size += len(turn)
        if started:
            ready.append(part(now, number, pieces, spans))
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    events = _ordered(log, "conv_id", ["message", "seq"]).select("conv_id", "key", "kind", "role", "text")
    return events.mapInArrow(fold, PARTS)


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted parts alone."""
    ship(parts.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state = None

        def done() -> None:
            conv, count, all_turns, chars, loss, size = state
            out.append((conv, count, all_turns.hexdigest(), chars, loss.hexdigest(), size))

        for conv, text, spans in _rows(batches, ["conv_id", "text", "loss"]):
            if state is None or state[0] != conv:
                if state is not None:
                    done()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in turns(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            for span in spans:
                learned = unescape(text[span["start"] : span["end"]])
                state[3] += len(learned)
                state[4].update(learned.encode())
            state[5] += len(text)
            if len(out) >= 10_000:
                yield _digests(out)
                out.clear()
        if state is not None:
            done()
        if out:
            yield _digests(out)

    return _ordered(parts, "conv_id", ["part"]).mapInArrow(digest, DIGESTS)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in DIGESTS.split(",")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def log_of_turns(table: DataFrame) -> DataFrame:
    """A log of a table of finished turns ``conv_id, turn, role, text`` that folds to it.

    A learned turn is opened empty and streamed in deltas, any other turn opened whole.
    By the hash of the text, one turn in four was first said otherwise: a learned one
    streams a draft and is regenerated, another is opened with its draft and edited; and
    one learned turn in four breaks off after its first delta and is edited to the end.
    Turns with the same number are ordered by role and text hash.
    """
    rows = table.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("mark", F.xxhash64("text"))

    def event(kind: str, said: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), said.alias("said"))

    said, nothing = F.col("text"), F.lit("")
    draft = F.concat(F.reverse(F.substring("text", 1, DELTA_CHARS)), F.lit(f" {END}{OPEN}"))
    deltas = F.transform(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0)), lambda x: event("delta", x)
    )
    way = F.pmod("mark", F.lit(4))
    learned = (
        F.when(
            way == 0,
            F.concat(F.array(event("open", nothing), event("delta", draft), event("regenerate", nothing)), deltas),
        )
        .when(way == 1, F.concat(F.array(event("open", nothing)), F.slice(deltas, 1, 1), F.array(event("edit", said))))
        .otherwise(F.concat(F.array(event("open", nothing)), deltas))
    )
    other = F.when(way == 0, F.array(event("open", draft), event("edit", said))).otherwise(F.array(event("open", said)))
    events = F.when(F.col("role") == LEARNED, learned).otherwise(other)
    return rows.select("conv_id", "turn", "role", "mark", "row", F.posexplode(events).alias("seq", "e")).select(
        "conv_id", "turn", "mark", "row", "seq", F.col("e.kind").alias("kind"), "role", F.col("e.said").alias("text")
    )


MESSAGE_ORDER = ["turn", "role", "mark", "row"]
