"""Windows of tokens, their counts and totals.

A token table has `sample_id` and `tokens` (array of any orderable type). A packed one has rows of many samples, `lengths` (array)
and `tokens` (32-bit ids, as bytes). An n-gram table has n, ngram and count."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lexibond.tables import Table

SCORES = ("log_likelihood", "max_segmentation_log_likelihood_sum", "pmi_score")


def token_field(i: int) -> str:
    return f"token_{i}"


def wide_schema(n: int, scores: tuple[str, ...] = ()) -> StructType:
    """The columns of one size's table: token_0.., count and some of SCORES. An unknown score raises."""
    if unknown := set(scores) - set(SCORES):
        raise ValueError(f"no column is named {sorted(unknown)}")
    tokens = [StructField(token_field(i), LongType(), False) for i in range(n)]
    return StructType([*tokens, StructField("count", LongType(), False), *[StructField(c, DoubleType()) for c in scores]])


def windows(tokens: Column, n: int) -> Column:
    """All windows of n tokens; an empty array if there are fewer (sequence() would otherwise count down)."""
    last = F.size(tokens) - n + 1
    none = F.slice(F.array(tokens), 1, 0)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(tokens, i, n))).otherwise(none)


def ngrams(tokens: DataFrame, sizes: list[int], keep: list[str] | None = None) -> DataFrame:
    """One row for each window of each size, all sizes in one pass over the corpus."""
    every = F.concat(*[windows(F.col("tokens"), n) for n in sizes])
    return tokens.select(*(keep or []), F.explode(every).alias("ngram")).select(*(keep or []), F.size("ngram").alias("n"), "ngram")


def count_ngrams(tokens: DataFrame, sizes: list[int], min_count: int = 1) -> DataFrame:
    """n, ngram, count of the n-grams found at least min_count times. Partial counts are made before the shuffle."""
    counted = ngrams(tokens, sizes).groupBy("n", "ngram").agg(F.count(F.lit(1)).alias("count"))
    return prune(counted, min_count)


HELD_TOKENS = 1_000_000  # that a task counts at once
ROWS = 65_536  # of a batch that a task returns
PAIRS = 1 << 24  # tasks hold a bitmap of 64 bits for each of so many pairs at most: 128 MB


def _arrays(ids: DataFrame) -> DataFrame:
    """What tasks read of a token table, packed or not."""
    return ids.select("lengths", "tokens") if "lengths" in ids.columns else ids.select("tokens")


def _samples(batches):
    """Arrow batches of token arrays, or of packed ones -> all tokens of a batch or row, and where samples start and end."""
    for rows in batches:
        if rows.num_columns == 1:
            every = rows.column(0)
            upto = every.offsets.to_numpy().astype(np.int64)
            yield every.flatten().to_numpy(zero_copy_only=False), upto - upto[0]
            continue
        for i in range(rows.num_rows):
            lengths = rows.column(0)[i].values.to_numpy()
            yield np.frombuffer(rows.column(1)[i].as_buffer(), np.int32), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _held(batches, most: int):
    """All tokens in a row and where samples end, about `most` at a time."""
    flat, ends, size = [], [], 0
    for every, upto in _samples(batches):
        at = 0
        while at < len(upto) - 1:
            # up to the sample that fills a share: a batch may hold several
            end = max(at + 1, min(len(upto) - 1, int(np.searchsorted(upto, upto[at] + most - size, side="left"))))
            flat.append(every[upto[at] : upto[end]].astype(np.int64))
            ends.append(upto[at + 1 : end + 1] - upto[at] + size)
            size, at = size + len(flat[-1]), end
            if size >= most:
                yield np.concatenate(flat), np.concatenate(ends)
                flat, ends, size = [], [], 0
    if size:
        yield np.concatenate(flat), np.concatenate(ends)


def _part_counts(flat: np.ndarray, ends: np.ndarray, sizes: range, frequent: np.ndarray | None, pairs: np.ndarray | None):
    """(n, first places of the distinct n-grams, counts) of some samples. frequent: which ids can be in an n-gram that is
    wanted; pairs: the bitmap of those (first << 32 | second) that can be in one of three or more."""
    known = flat >= 0
    if 1 in sizes:
        ids, first, count = np.unique(flat, return_index=True, return_counts=True)
        yield 1, first[ids >= 0], count[ids >= 0]
    alive = known.copy()
    alive[:-1] &= known[1:]
    alive[ends[ends > 0] - 1] = False  # no window goes on beyond a sample
    if frequent is not None:
        often = np.append(frequent, False)[np.minimum(flat, len(frequent))]
        alive &= often
        alive[:-1] &= often[1:]
    code = flat
    for n in range(2, max(sizes) + 1):
        at = np.flatnonzero(alive)
        key = code[at] << 32 | code[at + 1]
        if n == 2 and pairs is not None:
            known = _maybe(pairs, key)
            alive[at[~known]] = False
            at, key = at[known], key[known]
        if not len(at):
            return
        _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        if n in sizes:
            yield n, at[first], count
        # an n-gram is two that overlap in all but their ends
        code = np.zeros(len(flat), np.int64)
        code[at] = inverse
        alive[:-1] &= alive[1:]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and their counts."""
    key = np.sort(key)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[starts], np.diff(np.append(starts, len(key)))


def _tasks_parts(columns: list[np.ndarray], kinds: list[str], names: list[str]):
    for a in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + ROWS].astype(k)) for c, k in zip(columns, kinds, strict=True)], names=names)


def _alive(flat: np.ndarray, ends: np.ndarray, frequent: np.ndarray | None) -> np.ndarray:
    """Which places begin a pair of wanted tokens within a sample."""
    wanted = flat >= 0 if frequent is None else (flat >= 0) & np.append(frequent, False)[np.minimum(flat, len(frequent))]
    alive = wanted.copy()
    alive[:-1] &= wanted[1:]
    alive[ends[ends > 0] - 1] = False  # no window goes on beyond a sample
    return alive


def count_pairs(ids: DataFrame, frequent: np.ndarray | None = None, min_count: int = 1) -> DataFrame:
    """key (first << 32 | second), count."""
    sent, held, shares = ids.sparkSession.sparkContext.broadcast(frequent), HELD_TOKENS, _shares(ids)

    def run(batches):
        for flat, ends in _held(batches, held):
            at = np.flatnonzero(_alive(flat, ends, sent.value))
            key, count = _runs(flat[at] << 32 | flat[at + 1])
            yield _dealt(2, key, None, None, count, shares)

    return _summed(_arrays(ids).mapInArrow(run, _DEALT), shares, min_count).select("key", "count")


SHARE_BYTES = 8 << 20  # of the ids' files for each task that adds up counts
_DEALT = "share int, n int, key binary, more binary, last binary, count binary"
_SUMMED = ("n", "key", "more", "last", "count")


def _shares(ids: DataFrame) -> int:
    """How many tasks add up the counts of a table of ids."""
    size, spark = int(ids._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), ids.sparkSession
    known = size < 1 << 50  # else the plan doesn't know
    return max(spark.sparkContext.defaultParallelism, -(-size // SHARE_BYTES) if known else int(spark.conf.get("spark.sql.shuffle.partitions")))


def _dealt(n: int, key: np.ndarray, more: np.ndarray | None, last: np.ndarray | None, count: np.ndarray, shares: int) -> pa.RecordBatch:
    """The counts of one size in a row for each share, whose numbers of 64 bits go through the shuffle as bytes. Equal n-grams come to
    one share."""
    mixed = key.astype(np.uint64)
    for other in (more, last):
        if other is not None:
            mixed = (mixed ^ mixed >> np.uint64(29)) * _SPREAD + other.astype(np.uint64)
    share = ((mixed ^ mixed >> np.uint64(29)) * _SPREAD >> np.uint64(33)) % np.uint64(shares)
    order = np.argsort(share.astype(np.uint16 if shares < 1 << 16 else np.int64), kind="stable")
    sizes = np.bincount(share.astype(np.int64), minlength=shares)
    there = np.flatnonzero(sizes)
    ends = np.concatenate([[0], np.cumsum(sizes[there])])

    def column(values):
        offsets = (ends * 8 if values is not None else ends * 0).astype(np.int32)
        data = b"" if values is None else values[order].astype(np.int64)
        return pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    columns = [pa.array(there.astype(np.int32)), pa.array(np.full(len(there), n, np.int32)), *map(column, (key, more, last, count))]
    return pa.RecordBatch.from_arrays(columns, names=["share", *_SUMMED])


def _summed(parts: DataFrame, shares: int, min_count: int) -> DataFrame:
    """n, key, more, last (-1 where a size has none) and count of what _dealt made, added up and pruned in arrays."""

    def run(batches):
        held = {}
        for rows in batches:
            columns = [rows.column(i).to_pylist() for i in range(2)]
            for i, at in enumerate(zip(*columns, strict=True)):
                held.setdefault(at, []).append([np.frombuffer(rows.column(2 + c)[i].as_buffer(), np.int64).copy() for c in range(4)])
        for share, n in list(held):
            columns = [np.concatenate(c) for c in zip(*held.pop((share, n)), strict=True)]
            named = {name: c for name, c in zip(_SUMMED[1:], columns, strict=True) if len(c)}
            if not named:
                continue
            keys = [name for name in named if name != "count"]
            summed = pa.table(named).group_by(keys, use_threads=False).aggregate([("count", "sum")])
            summed = summed.filter(pc.greater_equal(summed.column("count_sum"), min_count)) if min_count > 1 else summed
            none = np.full(len(summed), -1)
            done = [np.full(len(summed), n), *[summed.column(name).to_numpy() if name in keys else none for name in _SUMMED[1:4]], summed.column("count_sum").to_numpy()]
            yield from _tasks_parts(done, ["i4", "i8", "i8", "i4", "i8"], list(_SUMMED))

    return parts.repartitionById(shares, F.col("share")).mapInArrow(run, "n int, key long, more long, last int, count long")


_SPREAD = np.uint64(0x9E3779B97F4A7C15)  # odd, so that keys differ in its upper bits


def _places(key: np.ndarray, bits: int) -> np.ndarray:
    """The place of each key in a bitmap of 2^bits."""
    key = key.astype(np.uint64)
    return ((key ^ (key >> np.uint64(29))) * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)


def _maybe(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys can be among those that the bitmap was made of: all of them, and few others."""
    at = _places(key, (len(bitmap) * 8).bit_length() - 1)
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 != 0


def pair_bitmap(double: DataFrame) -> np.ndarray:
    """A bitmap of the pairs in `double` (key), with 16 bits or more for each, and of PAIRS * 8 bytes at most, whatever their
    number. It is made in tasks, and the driver only puts its pieces of 4 KB together."""
    bits = max(15, min((16 * double.count()).bit_length(), (64 * PAIRS).bit_length() - 1))

    def run(batches):
        for rows in batches:
            at = _places(rows.column(0).to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> 15).astype(np.int32)), pa.array(at & 32767)], names=["piece", "at"])

    pieces = double.select("key").mapInArrow(run, "piece int, at long").groupBy("piece").agg(F.bitmap_construct_agg("at").alias("bits")).toArrow()
    out = np.zeros((1 << bits - 15, 4096), np.uint8)
    for piece, held in zip(pieces.column("piece").to_numpy(), pieces.column("bits"), strict=True):
        out[piece] = np.frombuffer(held.as_buffer(), np.uint8)
    return out.ravel()


def _count_longer(ids: DataFrame, sizes: list[int], pairs: np.ndarray, min_count: int) -> DataFrame:
    """n, ngram, count of sizes from 3 to 5, made of pairs that can be frequent by their bitmap. Within a task the place of a pair
    among its pairs stands for two tokens, so that an n-gram is a number of 64 bits and at most one token more."""
    sent, held, shares = ids.sparkSession.sparkContext.broadcast(pairs), HELD_TOKENS, _shares(ids)

    def run(batches):
        for flat, ends in _held(batches, held):
            at = np.flatnonzero(_alive(flat, ends, None))
            key = flat[at] << 32 | flat[at + 1]
            known = _maybe(sent.value, key)
            distinct, code = np.unique(key[known], return_inverse=True)
            place = np.full(len(flat), -1, np.int64)
            place[at[known]] = code
            del key, known, at, code
            alive = place >= 0
            alive[:-1] &= alive[1:].copy()
            alive[-1:] = False
            at = np.flatnonzero(alive)  # three tokens
            if 3 in sizes:
                key, count = _runs(place[at] << 32 | flat[at + 2])
                yield _dealt(3, distinct[key >> 32], None, key & 0xFFFFFFFF, count, shares)
            if max(sizes) < 4:
                continue
            at = at[place[np.minimum(at + 2, len(flat) - 1)] >= 0]  # four
            four = place[at] << 32 | place[at + 2]
            if 4 in sizes:
                key, count = _runs(four)
                yield _dealt(4, distinct[key >> 32], distinct[key & 0xFFFFFFFF], None, count, shares)
            if 5 in sizes:
                on = place[np.minimum(at + 3, len(flat) - 1)] >= 0
                at, four = at[on], four[on]
                fours, code = np.unique(four, return_inverse=True)
                key, count = _runs(code << 32 | flat[at + 4])
                four = fours[key >> 32]
                yield _dealt(5, distinct[four >> 32], distinct[four & 0xFFFFFFFF], key & 0xFFFFFFFF, count, shares)

    counted = _summed(_arrays(ids).mapInArrow(run, _DEALT), shares, min_count)

    def spell(batches):
        for rows in batches:
            n, key, more, last = (rows.column(i).to_numpy() for i in range(4))
            grams = np.full((len(n), 5), -1, np.int64)
            grams[:, 0], grams[:, 1] = key >> 32, key & 0xFFFFFFFF
            grams[:, 2] = np.where(n == 3, last, more >> 32)
            grams[:, 3], grams[:, 4] = more & 0xFFFFFFFF, last
            inside = np.arange(5) < n[:, None]
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            ngram = pa.ListArray.from_arrays(pa.array(ends), pa.array(grams[inside].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column(0), ngram, rows.column(4)], names=["n", "ngram", "count"])

    return Table(counted, "counts").df.mapInArrow(spell, "n int, ngram array<int>, count long")


def _count_parts(ids: DataFrame, sizes: range, frequent: np.ndarray | None = None, pairs: np.ndarray | None = None) -> DataFrame:
    top = max(sizes)
    names = ["n", *[token_field(i) for i in range(top)], "count"]
    sent, held = ids.sparkSession.sparkContext.broadcast((frequent, pairs)), HELD_TOKENS

    def run(batches):
        frequent, pairs = sent.value
        for flat, ends in _held(batches, held):
            for n, first, count in _part_counts(flat, ends, sizes, frequent, pairs):
                for a in range(0, len(first), ROWS):
                    at = first[a : a + ROWS]
                    tokens = [pa.array(flat[at + i].astype(np.int32)) if i < n else pa.array(np.full(len(at), -1, np.int32)) for i in range(top)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), *tokens, pa.array(count[a : a + ROWS].astype(np.int64))], names=names)

    kinds = ", ".join(f"{c} int" for c in names[:-1])
    parts = _arrays(ids).mapInArrow(run, f"{kinds}, count long")
    return parts.groupBy(*names[:-1]).agg(F.sum("count").alias("count"))


def _packed(counts: DataFrame) -> DataFrame:
    top = len(counts.columns) - 2
    return counts.select("n", F.slice(F.array(*[token_field(i) for i in range(top)]), F.lit(1), F.col("n")).alias("ngram"), "count")


def count_id_ngrams(ids: DataFrame, max_size: int, min_count: int = 1) -> DataFrame:
    """n, ngram, count like count_ngrams, for tokens that are ids of a vocabulary (ints from 0; n-grams with a negative one
    aren't counted).

    Size after size: only windows whose tokens, then pairs, are frequent enough can be, so rare ones are never shuffled. Tasks
    count in sorted arrays. Frequent ids are a bitmap of the vocabulary, frequent pairs a bitmap by hash, which lets a few others
    pass; what is counted in vain is pruned like all that is rare."""
    single = Table(prune(_count_parts(ids, range(1, 2)), min_count), "counts")
    done, frequent, pairs = _packed(single.df), None, None
    if max_size == 1:
        return done
    if min_count > 1:
        some = single.df.select(token_field(0)).toArrow().column(0).to_numpy().astype(np.int64)
        frequent = np.zeros(int(some.max(initial=-1)) + 1, bool)
        frequent[some] = True
    return done.unionByName(count_from_pairs(ids, list(range(2, max_size + 1)), min_count, frequent))


def spell_pairs(counted: DataFrame) -> DataFrame:
    """key, count of pairs -> n, ngram, count."""
    pair = F.array(F.shiftright("key", 32).cast("int"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    return counted.select(F.lit(2).alias("n"), pair.alias("ngram"), "count")


def count_from_pairs(ids: DataFrame, sizes: list[int], min_count: int, frequent: np.ndarray | None = None) -> DataFrame:
    """n, ngram, count of some sizes from 2 up. frequent: which ids are found min_count times; None if all that aren't negative are."""
    double = Table(count_pairs(ids, frequent, min_count), "counts")
    done, longer = spell_pairs(double.df if 2 in sizes else double.df.limit(0)), [n for n in sizes if n > 2]
    if not longer:
        return done
    pairs = pair_bitmap(double.df) if min_count > 1 else None
    if pairs is not None and max(longer) <= 5:
        for n in longer:  # one after the other, so that the disk holds the shuffle of one size
            done = done.unionByName(_count_longer(ids, [n], pairs, min_count))
        return done
    counted = Table(prune(_count_parts(ids, range(3, max(longer) + 1), frequent, pairs), min_count), "counts")
    return done.unionByName(_packed(counted.df).where(F.col("n").isin(longer)))


def count_in_batches(tokens: DataFrame, sizes: list[int], batch_size: int, min_count_batch: int, min_count: int = 1, dealt: bool = False) -> DataFrame:
    """Counts that first drop what is rare in a batch of batch_size consecutive sample ids, then sum over batches."""
    if min_count_batch <= 1:
        return count_ngrams(tokens, sizes, min_count)
    return prune(sum_batches(batch_counts(tokens, sizes, batch_size, min_count_batch, dealt)), min_count)


def batch_counts(tokens: DataFrame, sizes: list[int], batch_size: int, min_count_batch: int, dealt: bool = False) -> DataFrame:
    """dealt: all samples of a batch stand in one partition, one after the other. Then tasks count and prune batch after batch in
    arrays; only of a batch beyond HELD_TOKENS are partial counts shuffled."""
    batched = tokens.withColumn("batch_id", F.floor(F.col("sample_id") / batch_size))
    if dealt:
        return _dealt_counts(batched, sizes, min_count_batch)
    per = ngrams(batched, sizes, ["batch_id"]).groupBy("batch_id", "n", "ngram").agg(F.count(F.lit(1)).alias("count"))
    return prune(per, min_count_batch)


def _dealt_counts(batched: DataFrame, sizes: list[int], min_count: int) -> DataFrame:
    most, wanted = HELD_TOKENS, range(min(sizes), max(sizes) + 1)
    kind = batched.schema["tokens"].dataType.simpleString()

    def counted(batch, held, whole):
        tokens = pa.concat_arrays([pc.fill_null(t, []) if t.null_count else t for t in held])
        flat, ends = tokens.flatten().dictionary_encode(), tokens.offsets.to_numpy()[1:].astype(np.int64)
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(codes):
            return
        for n, first, count in _part_counts(codes, ends - (ends[-1] - len(codes)), wanted, None, None):
            if n not in sizes:
                continue
            first, count = (first[count >= min_count], count[count >= min_count]) if whole else (first, count)
            for a in range(0, len(first), ROWS):
                at = first[a : a + ROWS]
                ngram = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * n), flat.dictionary.take(pa.array(codes[at[:, None] + np.arange(n)].ravel())))
                same = lambda value, to: pa.array([value], to).take(pa.array(np.zeros(len(at), np.int32)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(batch, pa.int64()), same(n, pa.int32()), ngram, pa.array(count[a : a + ROWS].astype(np.int64)), same(whole, pa.bool_())], names=["batch_id", "n", "ngram", "count", "whole"])

    def run(batches):
        now, held, size, whole = object(), [], 0, True
        for rows in batches:
            ids, tokens = rows.column(0).to_pylist(), rows.column(1)
            upto, at = tokens.offsets.to_numpy(), 0
            while at < len(ids):
                if ids[at] != now:
                    if held:
                        yield from counted(now, held, whole)
                    now, held, size, whole = ids[at], [], 0, True
                end = at + 1
                while end < len(ids) and ids[end] == ids[at] and size + upto[end] - upto[at] < most:
                    end += 1
                held.append(tokens.slice(at, end - at))
                size += int(upto[end] - upto[at])
                at = end
                if size >= most:
                    # the batch may go on, so what is counted is a part of it
                    yield from counted(now, held, False)
                    held, size, whole = [], 0, False
        if held:
            yield from counted(now, held, whole)

    parts = batched.select("batch_id", "tokens").mapInArrow(run, f"batch_id long, n int, ngram {kind}, count long, whole boolean")
    table = Table(parts, "batches").df
    cut = table.where(~F.col("whole")).groupBy("batch_id", "n", "ngram").agg(F.sum("count").alias("count"))
    return table.where("whole").select("batch_id", "n", "ngram", "count").unionByName(prune(cut, min_count))


def sum_batches(counts: DataFrame) -> DataFrame:
    return counts.groupBy("n", "ngram").agg(F.sum("count").alias("count"))


def merge_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: counts of n-grams in both tables add up, others pass."""
    both = old.unionByName(new)
    return both.groupBy(*[c for c in old.columns if c != "count"]).agg(F.sum("count").alias("count"))


def prune(counts: DataFrame, min_count: int) -> DataFrame:
    return counts if min_count <= 1 else counts.where(F.col("count") >= min_count)


def totals_wide(tokens: DataFrame, max_size: int) -> DataFrame:
    """One row: t1..tN, the windows of each size over all samples, from lengths alone."""
    packed = "lengths" in tokens.columns
    sizes = tokens.select(F.explode("lengths").alias("size") if packed else F.size("tokens").alias("size"))
    return sizes.agg(*[F.coalesce(F.sum(F.greatest(F.col("size") - (n - 1), F.lit(0))).cast("long"), F.lit(0).cast("long")).alias(f"t{n}") for n in range(1, max_size + 1)])


def totals(tokens: DataFrame, max_size: int) -> DataFrame:
    """n, total for n = 1..N; sizes without a window have total 0."""
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"t{n}").alias("total")) for n in range(1, max_size + 1)])
    return totals_wide(tokens, max_size).select(F.inline(pairs))


def table_sizes(counts: DataFrame) -> DataFrame:
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("ngrams"))


def wide(counts: DataFrame, n: int) -> DataFrame:
    """The n-grams of one size with a column for each token: token_0 .. token_{n-1}."""
    rest = [c for c in counts.columns if c not in ("n", "ngram")]
    return counts.where(F.col("n") == n).select(*[F.col("ngram")[i].alias(token_field(i)) for i in range(n)], *rest)


def declared(counts: DataFrame, n: int) -> DataFrame:
    """The table of one size under its declared columns. An n-gram that stands in it twice, or a null, raises."""
    columns = wide_schema(n)
    table = wide(counts, n).select(*[F.col(f.name).cast(f.dataType) for f in columns])
    keys = [token_field(i) for i in range(n)]
    bad = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count("count").alias("counts")).where((F.col("rows") > 1) | (F.col("counts") < 1) | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)))
    if (first := bad.first()) is not None:
        raise ValueError(f"{tuple(first[k] for k in keys)} isn't one counted n-gram")
    return table
