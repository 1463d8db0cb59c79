"""Chat formatting by event-sourced reconstruction.

A log of events is dealt by conversation and sorted by sequence; each conversation's events are folded in one pass into
its final messages, which are then rendered. Kinds of event: `message` begins a message with its text so far, `delta`
appends to the latest message of that key, `edit` replaces its text, `regenerate` empties it so that new deltas follow,
`delete` takes it away. Events on a key that has no message begin one.

Rendering puts every turn between markers and escapes markers, and the control strings of common templates, inside roles
and texts by a backslash after their first sign; backslashes are doubled, so `unescape` gives back the exact text. The
loss mask is a list of [start, end) places (code points) that cover exactly the assistant texts.

Nulls: a null text or role is empty, a null conversation is a conversation of its own, null sequences come first. Equal
sequences are sorted by kind, role and text; repeated rows are repeated events. An empty log gives no rows. A conversation
is one output row, so it is the unit that one task holds; other columns of the log are left out."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibond.llm.shared import small_batches

# This template's markers, and strings that other templates give a meaning.
START, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (START, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.DOTALL)

FORMATTED = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def fold(events: list[tuple[str, str, str, str]]) -> list[tuple[str, str]]:
    """(kind, key, role, text) in order -> (role, text) of the final messages in order of their beginning."""
    messages: list[list[str] | None] = []
    latest: dict[str, int] = {}
    parts: dict[int, list[str]] = {}
    for kind, key, role, text in events:
        at = latest.get(key)
        if kind == "message" or at is None:
            if kind == "delete":
                continue
            latest[key] = at = len(messages)
            messages.append([role, ""])
            parts[at] = [text] if kind != "regenerate" else []
        elif kind == "delta":
            parts[at].append(text)
        elif kind == "edit":
            parts[at] = [text]
        elif kind == "regenerate":
            parts[at] = []
        elif kind == "delete":
            messages[at] = None
            del latest[key]
        else:
            raise ValueError(f"no event is of kind {kind}")
    return [(m[0], "".join(parts[i])) for i, m in enumerate(messages) if m is not None]


def render(messages: list[tuple[str, str]]) -> tuple[str, list[dict[str, int]]]:
    out, loss, at = [], [], 0
    for role, text in messages:
        head, body = START + escape(role) + BODY, escape(text)
        if role == "assistant":
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), loss


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list]]:
    """Rows sorted by conversation -> each conversation with its events; only one is held at a time."""
    held, events, any_row = None, [], False
    for rows in batches:
        cols = [rows.column(i).to_pylist() for i in range(5)]
        for conv, kind, key, role, text in zip(*cols, strict=True):
            if any_row and conv != held:
                yield held, events
                events = []
            held, any_row = conv, True
            events.append((kind, key, role, text))
    if any_row:
        yield held, events


def format_chat(log: DataFrame) -> DataFrame:
    """log: conv_id long, seq, key, kind, role, text -> conv_id, n_turns, formatted, loss."""
    small_batches(log.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slim = log.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("kind", F.lit("message")).alias("kind"), text("key").alias("key"), text("role").alias("role"), text("text").alias("text"), "seq")
    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("seq"), "kind", "role", "text").drop("seq")

    def run(batches):
        out, size = [], 0
        for conv, events in _conversations(batches):
            messages = fold(events)
            formatted, loss = render(messages)
            out.append((conv, len(messages), formatted, loss))
            size += len(formatted)
            if size > 4_000_000 or len(out) >= 1000:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    return dealt.mapInArrow(run, FORMATTED)


_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _batch(rows: list) -> pa.RecordBatch:
    conv, n, text, loss = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(n, pa.int64()), pa.array(text, pa.string()), pa.array(loss, _LOSS)], names=["conv_id", "n_turns", "formatted", "loss"])


def log_of_turns(conversations: DataFrame) -> DataFrame:
    """Finished conversations (conv_id, turn, role, text) as a log: each row is one whole message."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.col("turn").cast("string").alias("key"), F.lit("message").alias("kind"), "role", "text")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted text and its loss mask alone."""

    def run(batches):
        for rows in batches:
            out = []
            for conv, text, loss in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(text)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, DIGEST)
