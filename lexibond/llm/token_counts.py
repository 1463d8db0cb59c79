"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text longer than a chunk is encoded as overlapping chunks with offsets. Two neighbours are spliced at a place in their
overlap where both begin a new word of the splitting pattern: the pattern never looks back, so from there on both have
the tokens of the whole text, as long as the place is clear of the left chunk's cut end. Where no such place exists, the
overlap is doubled until there is one or the chunk reaches the end of the text.

Nulls count as empty texts: 0 bytes, 0 tokens. Every row gives one row, so repeated rows repeat; an empty table gives an
empty one; other columns pass through unless named n_bytes, n_tokens or over_limit, which are replaced."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexibond.llm.bpe_core import Library
from lexibond.llm.shared import small_batches

CHUNK = 65_536  # characters
OVERLAP = 1_024


def _edges(encoding, base: int) -> dict[int, int]:
    """Place in the text -> index of the token that begins a word of the pattern there."""
    words, offsets = encoding.word_ids, encoding.offsets
    out = {}
    for i, (w, (start, _)) in enumerate(zip(words, offsets, strict=True)):
        if i == 0 or w != words[i - 1] or w is None:
            out.setdefault(base + start, i)
    return out


def splice(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of a whole text from overlapping chunks of it."""
    ids: list[int] = []
    # characters before a cut end that aren't trusted: more than a special string or a contraction has
    guard = 8 + max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)
    start, place = 0, 0  # where the current chunk begins, and up to where ids has the tokens
    while True:
        end, wide = min(len(text), start + chunk), overlap
        left = tokenizer.encode(text[start:end], add_special_tokens=False)
        while end < len(text):
            after = max(start + 1, end - wide)  # the next chunk begins `wide` before this one's end
            stop = min(len(text), after + max(chunk, wide + chunk // 2))
            right = tokenizer.encode(text[after:stop], add_special_tokens=False)
            mine, other = _edges(left, start), _edges(right, after)
            sure = min(end, stop if stop < len(text) else end) - guard
            good = [p for p in mine if p in other and max(place, after + guard) < p <= min(sure, max(mine) - 1)]
            if good:
                break
            if wide < end - start - 1:
                wide *= 2
            else:  # no place in the whole chunk: take the chunk itself wider
                end = min(len(text), end + (end - start))
                left = tokenizer.encode(text[start:end], add_special_tokens=False)
        else:
            return ids + left.ids[_edges(left, start)[place] if text else 0 :]
        cut = max(good)
        ids += left.ids[mine[place] : mine[cut]]
        start, place = after, cut


def _count(file: str, chunk: int, overlap: int, rows: pa.RecordBatch) -> list[int]:
    library = Library.of(file)
    texts = [t or "" for t in rows.column(rows.schema.get_field_index("text")).to_pylist()]
    out = [0] * len(texts)
    short = [i for i, t in enumerate(texts) if len(t) <= chunk]
    for i, ids in zip(short, library.encode_many([texts[i] for i in short]), strict=True):
        out[i] = len(ids)
    for i, t in enumerate(texts):
        if len(t) > chunk:
            out[i] = len(splice(library.tokenizer, t, chunk, overlap))
    return out


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP, keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (all but text) with n_bytes, n_tokens and over_limit: more than `limit` tokens."""
    small_batches(docs.sparkSession)
    new = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in docs.columns if c not in ("text", *new)] if keep is None else keep
    slim = docs.select(*keep, F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    schema = StructType([f for f in slim.schema.fields if f.name != "text"] + [StructField("n_tokens", LongType())])

    def run(batches):
        for rows in batches:
            counts = _count(tokenizer_file, chunk, overlap, rows)
            cols = [rows.column(rows.schema.get_field_index(f.name)) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], names=[f.name for f in schema.fields])

    return slim.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
