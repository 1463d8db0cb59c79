"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash of the last bytes picks chunk ends by content, so that copies and shared passages fall into equal chunks
wherever they stand. Each worker encodes a chunk once and keeps its ids; a text's ids are those of its chunks, with the
joins repaired: where a join isn't a proven boundary of the splitting pattern, what stands between the nearest proven ones
on both sides is encoded again, and both chunks' tokens must agree with those places exactly; where there is none near, the
chunks are one from the start. So the work is linear in the text, whatever its script. Chunks are shared within a worker,
not over the cluster: a shuffle of chunk texts and ids would write more than the input, reading each text once writes nothing.

Nulls count as empty texts. One row for each row, repeated rows repeat, an empty table gives an empty one."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lexibond.llm.bpe_core import Bytes, Library
from lexibond.llm.shared import small_batches

WINDOW = 16  # bytes under the rolling hash
MEAN_BITS = 8  # a chunk has about 2^8 bytes more than the least
LEAST = 64
MOST = 16_384
NEAR = 1_024  # characters of both sides in which a join looks for proven places
REMEMBERED_BYTES = 24_000_000  # of chunk texts and ids a worker keeps

_NONE = np.zeros(0, np.int32)
_CODE = np.random.RandomState(11).randint(1, 2**62, 256).astype(np.uint64)


def rolling(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each byte the hash of the `window` bytes that end there (of fewer at the beginning)."""
    h = _CODE[data]
    step, base = 1, np.array([0x100000001B3], np.uint64)
    while step < window:  # h covers `step` bytes; doubled until the window is covered
        more = h.copy()
        more[step:] += h[:-step] * base
        h, base, step = more, base * base, step * 2
    return h ^ (h >> np.uint64(29))


# Characters whose class no version of Unicode changed, and the class changes at which the splitting pattern
# always ends a word, whatever stands before. Apostrophes (contractions) and the signs of special strings take no part.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_DIGITS = "0-9"
_SIGNS = r"!-&(-/:;=?-@\[-`{}~\u3001-\u3003\u3008-\u3011\uff01\uff0c\uff1a\uff1b\uff1f"
_CUT = re.compile(rf"(?<=[{_LETTERS}])(?=[{_DIGITS}{_SIGNS}' \n\t])|(?<=[{_DIGITS}])(?=[{_LETTERS}{_SIGNS}' \n\t])|(?<=[{_SIGNS}])(?=[{_LETTERS}{_DIGITS} \n\t])")


def chunk_ends(text: bytes, mean_bits: int = MEAN_BITS, least: int = LEAST, most: int = MOST, cuts: Callable[[], np.ndarray] | None = None) -> list[int]:
    """Byte places where chunks end: by content before a space; where none comes for `most` bytes, at the next of `cuts`
    (proven byte places of the text), if there is one."""
    n = len(text)
    if n <= least:
        return [n] if n else []
    data = np.frombuffer(text, np.uint8)
    mask = np.uint64((1 << max(0, mean_bits - 3)) - 1)  # about one byte in 2^3 is followed by a space
    ends = np.flatnonzero(((rolling(data)[:-1] & mask) == 0) & (data[1:] == 32)) + 1
    out, at, places = [], 0, None
    for e in [*ends.tolist(), n]:
        while e - at > most and cuts:
            places = cuts() if places is None else places
            i = int(np.searchsorted(places, at + most))
            if i == len(places) or places[i] >= e:
                break
            at = int(places[i])
            out.append(at)
        if e - at >= least or e == n:
            if e > at:
                out.append(e)
            at = e
    return out


def _sign(c: str) -> bool:
    """A letter or ASCII sign: no alternative of the splitting pattern runs from it into a space, and none looks back."""
    return "!" <= c <= "~" or (c > "\x7f" and c.isalpha())


def proven(left: str, right: str) -> bool:
    """Whether a text may be cut between the two without changing tokens."""
    return right[:1] == " " and bool(left) and _sign(left[-1])


class Codec:
    _open: dict[str, Codec] = {}

    def __init__(self, file: str) -> None:
        self.library, self.bytes = Library.of(file), Bytes.of(file)
        special = sorted(self.library.special_strings(), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.longest = max(map(len, special), default=0)
        self.kept: OrderedDict[str, np.ndarray] = OrderedDict()
        self.size = 0

    @classmethod
    def of(cls, file: str) -> Codec:
        if file not in cls._open:
            cls._open[file] = cls(file)
        return cls._open[file]

    def cuts(self, text: str, start: int = 0, end: int | None = None) -> list[int]:
        """The proven places of a text in [start, end)."""
        inside = {i for m in self.special.finditer(text, max(0, start - self.longest), min(len(text), (len(text) if end is None else end) + self.longest)) for i in range(m.start() + 1, m.end())} if self.special else ()
        return [m.start() for m in _CUT.finditer(text, start, len(text) if end is None else end) if m.start() > start and m.start() not in inside]

    def _byte_cuts(self, text: str) -> np.ndarray:
        sizes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (sizes > 0x7F).astype(np.int64) + (sizes > 0x7FF) + (sizes > 0xFFFF)
        return np.concatenate([[0], np.cumsum(width)])[np.array(self.cuts(text), np.int64)]

    def chunks(self, texts: list[str], **how) -> list[list[str]]:
        out = []
        for t in texts:
            raw, at, own = t.encode(), 0, []
            for e in chunk_ends(raw, cuts=lambda t=t: self._byte_cuts(t), **how):
                own.append(raw[at:e].decode())
                at = e
            out.append(self._glued(own))
        return out

    def _glued(self, own: list[str]) -> list[str]:
        """Chunks whose join is neither proven nor has proven places near on both sides are one."""
        if all(proven(a, b) for a, b in zip(own, own[1:], strict=False)):
            return own
        out: list[list[str]] = []
        for c in own:
            if out and not (proven(out[-1][-1], c) or (self.cuts(out[-1][-1], max(0, len(out[-1][-1]) - NEAR)) and self.cuts(c, 0, NEAR))):
                out[-1].append(c)
            else:
                out.append([c])
        return ["".join(parts) for parts in out]

    def encode_many(self, texts: list[str], **how) -> list[np.ndarray]:
        cut = self.chunks(texts, **how)
        need = set().union(*cut) if cut else set()
        new = [c for c in need if c not in self.kept]
        fresh = dict(zip(new, self.library.encode_many(new), strict=True)) if new else {}
        found = {c: fresh[c] if c in fresh else self.kept[c] for c in need}
        for c, ids in fresh.items():
            self.kept[c] = ids
            self.size += 4 * len(c) + 4 * len(ids) + 200
        for c in need:
            self.kept.move_to_end(c)
        while self.size > REMEMBERED_BYTES and self.kept:
            c, ids = self.kept.popitem(last=False)
            self.size -= 4 * len(c) + 4 * len(ids) + 200
        out = []
        for own in cut:
            if all(proven(a, b) for a, b in zip(own, own[1:], strict=False)):
                out.append(np.concatenate([_NONE, *[found[c] for c in own]]))
            else:
                out.append(self._repaired(own, found))
        return out

    def _repaired(self, own: list[str], found: dict[str, np.ndarray]) -> np.ndarray:
        """Joins left to right. What stands before the last proven place is done; the rest, text and ids, is at hand."""
        done, text, ids = [], own[0], found[own[0]]
        for c in own[1:]:
            if proven(text, c):
                done.append(ids)
                text, ids = c, found[c]
                continue
            before, after = self.cuts(text, max(0, len(text) - NEAR)), self.cuts(c, 0, NEAR)
            left = before[0] if before else 0
            i = _token_from_end(self.bytes.lengths[ids], len(text[left:].encode()))
            j = _token_at(self.bytes.lengths[found[c]], len(c[: after[-1]].encode())) if after else None
            if i is None:  # can't be for a proven place: all at hand is encoded again
                left, i = 0, 0
            if j is None:  # the end of this chunk isn't proven: it stays at hand
                done.append(ids[:i])
                text = text[left:] + c
                ids = self.library.encode_many([text])[0]
                continue
            done += [ids[:i], self.library.encode_many([text[left:] + c[: after[-1]]])[0]]
            text, ids = c[after[-1] :], found[c][j:]
        return np.concatenate([_NONE, *done, ids])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes.decode(ids)


def _token_at(lengths: np.ndarray, place: int) -> int | None:
    """Index of the token that begins at a byte place, or None if none does."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    i = int(np.searchsorted(ends, place))
    return i if ends[i] == place else None


def _token_from_end(lengths: np.ndarray, size: int) -> int | None:
    """Index of the token from which on the tokens have `size` bytes, or None."""
    n = min(len(lengths), size)  # no token is empty
    i = _token_at(lengths[len(lengths) - n :][::-1], size)
    return None if i is None else len(lengths) - i


def encode_decode(docs: DataFrame, tokenizer_file: str, keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (all but text) with ids (array of int) and decoded (string)."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("text", "ids", "decoded")] if keep is None else keep
    slim = docs.select(*keep, "text")
    schema = StructType([*[f for f in slim.schema.fields if f.name != "text"], StructField("ids", ArrayType(IntegerType(), False)), StructField("decoded", StringType())])

    def run(batches):
        codec = Codec.of(tokenizer_file)
        for rows in batches:
            texts = [t or "" for t in rows.column(rows.schema.get_field_index("text")).to_pylist()]
            ids = codec.encode_many(texts)
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate([_NONE, *ids]), pa.int32())
            decoded = pa.array([codec.decode(i).decode() for i in ids], pa.string())
            cols = [rows.column(rows.schema.get_field_index(f.name)) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(ends, flat), decoded], names=[f.name for f in schema.fields])

    return slim.mapInArrow(run, schema)
