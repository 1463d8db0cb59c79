"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Only the order of suffixes through `width` bytes matters: suffixes that agree so far are one group, and all but the first
of a group begin a repeated string. The sort goes by most significant digits, and a group leaves as soon as it is decided:

1. The first digit is the GRAM-byte hash that is smallest among those inside the string (the last of equals). It depends
   on the string alone, so equal strings have it at the same place, and neighbouring suffixes share it: one record stands
   for a run of suffixes around an anchor. Records of an anchor hash that occurs once are decided: not repeated.
2. The second digit is the hash of all bytes that the run's strings cover. Records that agree in it are repeated whole,
   but for the first. Where an anchor hash has several such classes, the first of each goes on.
3. What remains is divided into runs of BLOCK neighbouring suffixes and sorted by the bytes that all strings of such a
   run share, then by the bytes that they cover, in the same way.
4. The last digit is the string itself: all but the first of equal strings are repeated.

Hashes stand for bytes (128 bits decide). Before each shuffle a task decides what it can: of equal records or strings among
HELD ones only the first is sent, so a string that every document has reaches a task a few times for each part of the input.
An anchor hash with many classes among these is hot: its records are dealt by class instead
of by anchor, and two marks tell the anchor's own task that it has several classes.

Earlier means a smaller id or, in the same document, an earlier start. Rows of one id are taken as one document in this:
strings at the same start aren't earlier than each other (so all of them go on as first ones, and repeated rows as one
record). Every record carries its text's 64-bit hash, and a removal applies to the rows with that id and text. Null ids come
after all others. A null text is empty. Every row gives one row (exact repeats of id and text are judged alike), other
columns are left out, texts shorter than `width` bytes stay whole, an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibond.llm.shared import Table, mix64, small_batches

WIDTH = 100
GRAM = 32
CHUNK = 1 << 18  # suffixes of a text that are handled at once
BLOCK = 8  # neighbouring suffixes of the third digit
HELD = 400_000  # records that a task decides among before it sends any
HOT = 32  # classes of one anchor hash among these
LAST_ID = (1 << 63) - 1  # stands for a null id

_MASK = np.uint64((1 << 20) - 1)
_CODES = np.random.RandomState(23).randint(1, 2**62, (2, 256)).astype(np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    have = _TABLES.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 4096)
        size = 1 << (size - 1).bit_length()
        out = []
        for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _TABLES[which] = have = (out[0], out[1])
    return have


class Spans:
    """Hashes of any part of a text in constant time each."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        up, self.down = _powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[which][data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


def anchors(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes by anchor: hash of the anchor, hash of the bytes of the run, anchor place, first and last start."""
    n = len(data) - width + 1
    out = []
    for at in range(0, max(n, 0), CHUNK):
        own = data[at : min(len(data), at + CHUNK + width - 1)]
        m = len(own) - width + 1
        spans = Spans(own)
        first = np.arange(len(own) - gram + 1)
        h = spans.of(first, first + gram)
        v = (h & ~_MASK) | (_MASK - first.astype(np.uint64))
        reach, low = width - gram + 1, v
        step = 1
        while step * 2 <= reach:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < reach:
            low = np.minimum(low[: m], low[reach - step : reach - step + m])
        place = (_MASK - (low[:m] & _MASK)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([begin[1:], [m]]) - 1
        p = place[begin]
        u = mix64(spans.of(begin, last + width) + (p - begin).astype(np.uint64) * np.uint64(131) + (p - last).astype(np.uint64))
        out.append((h[p], u, p + at, begin + at, last + at))
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching [start, end)."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])) if len(start) else np.zeros(0, np.int64)
    return start[new], reach[np.concatenate([new[1:], [len(start)]]) - 1] if len(start) else reach


# Rows between stages. kind 0: a record dealt by anchor, 1: by class, 2: a mark, 3: a decided removal (digit = start, place = end).
# tag is the hash of the text; place packs the anchor's (or string's) start and the run: start << 14 | before << 7 | after.
ROWS = "key long, digit long, doc long, tag long, place long, kind int"
_NAMES = ["key", "digit", "doc", "tag", "place", "kind"]


def _rows(key, digit, doc, tag, place, kind) -> pa.RecordBatch:
    kinds = np.full(len(key), kind, np.int32) if np.isscalar(kind) else kind
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).view(np.int64) if np.asarray(c).dtype == np.uint64 else c) for c in (key, digit, doc, tag, place)] + [pa.array(kinds, pa.int32())], names=_NAMES)


def _firsts(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by all columns, and which rows of that order are the first of their class (equal first two columns)."""
    order = np.lexsort(cols[::-1])
    a, b = cols[0][order], cols[1][order]
    return order, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)


def _removed(doc: np.ndarray, tag: np.ndarray, place: np.ndarray, width: int) -> pa.RecordBatch:
    """Records that are repeated whole, as rows of kind 3: digit is the first byte, place the end.

    Overlapping removals of a text become one row."""
    start = place >> 14
    a, b = start - ((place >> 7) & 127), start - (place & 127) + width
    order = np.lexsort((a, tag, doc))
    doc, tag, a, b = doc[order], tag[order], a[order], b[order]
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    text = np.cumsum(other) << 40  # texts apart, so that one running maximum serves all
    reach = np.maximum.accumulate(text + b)
    new = np.flatnonzero(np.concatenate([[True], text[1:] + a[1:] > reach[:-1]]))
    end = (reach - text)[np.concatenate([new[1:], [len(a)]]) - 1]
    doc, tag, a = doc[new], tag[new], a[new]
    return _rows(mix64(tag.astype(np.uint64) * np.uint64(31) + a.astype(np.uint64)), a, doc, tag, end, 3)


def _ties(doc: np.ndarray, tag: np.ndarray, place: np.ndarray, first: np.ndarray, lead=(0, 0), before=None):
    """Of rows in order: which start where the first of their class does in the same document, so that neither is earlier, and
    which repeat the row before them. lead: document and start of the class that goes on from before, before: the row before."""
    start, at = place >> 14, np.flatnonzero(first)
    which = np.cumsum(first)
    tied = (doc == np.concatenate([[lead[0]], doc[at]])[which]) & (start == np.concatenate([[lead[1]], start[at]])[which])
    same = np.zeros(len(doc), bool)
    same[1:] = ~first[1:] & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (place[1:] == place[:-1])
    if before is not None and not first[0]:
        same[0] = before == (doc[0], tag[0], place[0])
    return tied, same


def _send(key: np.ndarray, digit: np.ndarray, doc: np.ndarray, tag: np.ndarray, place: np.ndarray, width: int):
    """What a task sends of a batch: removals that it can decide, the first of each class, and marks of hot keys."""
    order, first = _firsts([key, digit, doc, place, tag])
    key, digit, doc, tag, place = key[order], digit[order], doc[order], tag[order], place[order]
    tied, same = _ties(doc, tag, place, first)
    if (~tied).any():
        yield _removed(doc[~tied], tag[~tied], place[~tied], width)
    keys, count = np.unique(key[first], return_counts=True)
    sent = tied & ~same
    key, digit, doc, tag, place = key[sent], digit[sent], doc[sent], tag[sent], place[sent]
    hot = (count >= HOT)[np.searchsorted(keys, key)]
    yield _rows(np.where(hot, mix64(key ^ mix64(digit)), key), digit, doc, tag, place, hot.astype(np.int32))
    marks = keys[count >= HOT]
    if len(marks):
        twice, zero = np.repeat(marks, 2), np.zeros(2 * len(marks), np.int64)
        yield _rows(twice, np.tile(np.array([-1, -2]), len(marks)), zero, zero, zero, 2)


def _records(docs: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches):
        got, size = [], 0
        for rows in batches:
            for doc, tag, text in zip(*[rows.column(i).to_pylist() for i in range(3)], strict=True):
                if len(text) < width:
                    continue
                h, u, p, begin, last = anchors(np.frombuffer(text, np.uint8), width, gram)
                got.append((h, u, np.full(len(h), doc, np.int64), np.full(len(h), tag, np.int64), p << 14 | (p - begin) << 7 | (p - last)))
                size += len(h)
                if size >= HELD:
                    yield from _send(*(np.concatenate(c) for c in zip(*got, strict=True)), width)
                    got, size = [], 0
        if got:
            yield from _send(*(np.concatenate(c) for c in zip(*got, strict=True)), width)

    return docs.mapInArrow(run, ROWS)


def _classes(rows: DataFrame, width: int) -> DataFrame:
    """Decides records by their two digits. Rows come sorted; kind 3 passes and is added to, kind 0 is what remains."""

    def run(batches):
        last = None  # (key, digit) of the last row
        lead, before = (0, 0), None  # document and start of the first row of the open class; document, text and place of the last row
        held = None  # the first rows of the open anchor while it has one class
        many = False  # whether the open anchor has several classes
        for batch in batches:
            key, digit, doc, tag, place, kind = (batch.column(i).to_numpy() for i in range(6))
            passing = kind == 3
            if passing.any():
                yield _rows(key[passing], digit[passing], doc[passing], tag[passing], place[passing], 3)
                key, digit, doc, tag, place, kind = (c[~passing] for c in (key, digit, doc, tag, place, kind))
            if not len(key):
                continue
            goes_on = last is not None and last[0] == key[0]
            new_key = np.concatenate([[not goes_on], key[1:] != key[:-1]])
            new_class = new_key | np.concatenate([[not (goes_on and last[1] == digit[0])], digit[1:] != digit[:-1]])
            tied, same = _ties(doc, tag, place, new_class, lead, before)
            again = ~tied & (kind != 2)
            fresh = tied & ~same & (kind != 2)
            if again.any():
                yield _removed(doc[again], tag[again], place[again], width)
            run_of = np.cumsum(new_key) - new_key[0]  # 0 is the open anchor, or the first if none goes on
            run_of = run_of - run_of[0]
            classes = np.bincount(run_of, weights=new_class).astype(np.int64)
            if goes_on:
                classes[0] += 2 if many else 1
                if classes[0] >= 2 and held is not None:
                    yield _rows(*held, 0)
                    held = None
            else:
                held = None
            sent = fresh & ((classes[run_of] >= 2) | (kind == 1))
            if sent.any():
                yield _rows(key[sent], digit[sent], doc[sent], tag[sent], place[sent], 0)
            end = run_of == run_of[-1]
            many = bool(classes[-1] >= 2)
            lone = np.flatnonzero(end & fresh & (kind == 0))
            if many or run_of[-1]:
                held = None
            if not many and len(lone):
                own = (key[lone], digit[lone], doc[lone], tag[lone], place[lone])
                held = own if held is None else tuple(np.concatenate(c) for c in zip(held, own, strict=True))
            last, before = (key[-1], digit[-1]), (doc[-1], tag[-1], place[-1])
            if new_class.any():
                i = np.flatnonzero(new_class)[-1]
                lead = (doc[i], place[i] >> 14)

    return rows.repartition("key").sortWithinPartitions("key", "digit", "doc", "place", "tag").mapInArrow(run, ROWS)


def _narrower(docs: DataFrame, open_runs: DataFrame, width: int, block: int) -> DataFrame:
    """The runs that are still open, divided at multiples of `block` before the anchor. The key is the hash of the bytes
    that all strings of a whole block share, the digit that of the bytes that the strings at hand cover."""
    wanted = open_runs.groupBy("doc", "tag").agg(F.collect_list("place").alias("places"))
    mine = docs.select("doc", "tag", "bytes").join(wanted, ["doc", "tag"]).select("doc", "tag", "bytes", "places")

    def run(batches):
        got, size = [], 0
        for rows in batches:
            for doc, tag, text, places in zip(*[rows.column(i).to_pylist() for i in range(4)], strict=True):
                place, data = np.unique(np.array(places, np.int64)), np.frombuffer(text, np.uint8)
                for at in range(0, len(place), CHUNK // 64):
                    own = place[at : at + CHUNK // 64]
                    p, far, near = own >> 14, (own >> 7) & 127, own & 127
                    n = far // block - near // block + 1
                    which = np.repeat(np.arange(len(own)), n)
                    j = (near // block)[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    p, far, near = p[which], np.minimum(far[which], j * block + block - 1), np.maximum(near[which], j * block)
                    low, top = int((p - far).min()), int((p - near).max()) + width
                    spans, more, q = Spans(data[low:top]), Spans(data[low:top], 1), p - low
                    key = mix64(spans.of(q - j * block, q - (j * block + block - 1) + width) + j.astype(np.uint64) * np.uint64(257))
                    digit = mix64(more.of(q - far, q - near + width) + (far * 128 + near).astype(np.uint64))
                    got.append((key, digit, np.full(len(p), doc, np.int64), np.full(len(p), tag, np.int64), p << 14 | far << 7 | near))
                    size += len(p)
                    if size >= HELD:
                        yield from _send(*(np.concatenate(c) for c in zip(*got, strict=True)), width)
                        got, size = [], 0
        if got:
            yield from _send(*(np.concatenate(c) for c in zip(*got, strict=True)), width)

    return mine.mapInArrow(run, ROWS)


def _cut(docs: DataFrame, removals: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (bytes that are left) and spans (the removed runs)."""
    tagged = removals.select("doc", "tag", F.struct(F.col("digit").alias("a"), F.col("place").alias("b")).alias("x"))
    lists = tagged.groupBy("doc", "tag").agg(F.collect_list("x").alias("xs"))
    mine = docs.join(lists, ["doc", "tag"], "left").select("doc_id", "bytes", F.col("xs.a").alias("a"), F.col("xs.b").alias("b"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for rows in batches:
            kept, spans, sizes = [], [], []
            for text, a, b in zip(*[rows.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                start, end = merge(np.array(a or [], np.int64), np.array(b or [], np.int64))
                parts, at = [], 0
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    parts.append(text[at:s])
                    at = e
                kept.append(b"".join([*parts, text[at:]]))
                spans.append([{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist(), strict=True)])
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=["doc_id", "n_bytes", "kept", "spans"])

    return mine.mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs: doc_id, text -> doc_id, n_bytes, kept (bytes), spans (removed runs of bytes, maximal)."""
    if not gram < width <= 120:
        raise ValueError("strings must be longer than a gram and of 120 bytes at most")
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("tag"), F.encode(text, "UTF-8").alias("bytes"))
    source = slim.select("doc", "tag", "bytes")
    passes = []
    rows = _records(source, width, gram)
    for block in (BLOCK, 1, None):
        passes.append(Table(_classes(rows, width).select("digit", "doc", "tag", "place", "kind"), "suffix-pass"))
        rows = None if block is None else _narrower(source, passes[-1].df.where(F.col("kind") == 0), width, block)
    decided = passes[0].df.unionByName(passes[1].df).unionByName(passes[2].df).where(F.col("kind") == 3)
    return _cut(slim, decided)
