"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights; a term is a dimension. Candidates are packed into blocks, each held as
postings: for every term the rows that have it with their weights, as a list or, if most rows have it, as an array over
all rows. For some queries at a time, term after term scatters its weighted postings into a dense array of scores (queries
x rows of the block); a partition selection keeps the k best of each query, which the task merges over its blocks and a
window over tasks. Queries are blocks too, sent to every shard of candidates, so neither side is broadcast or held whole
anywhere.

Vectors that are null, or hold null, NaN or infinite components, take no part. Ids may be null: such a row can't be named
and takes no part. Repeated rows are candidates of their own; a row isn't its own candidate, and neither are rows of the
same id; of queries that share an id the one of the smallest vector asks. Ties go to the smaller id. Vectors of unequal length are padded with zeros. An empty table gives no rows.
Scores are exact: floats only where every sum fits them, then 64-bit integers, then Python's. Weights and scores beyond 64
bits are given as the largest or smallest 64-bit number, and such scores rank as equals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexibond.llm.shared import small_batches

ROWS = 4096  # candidates of a block
QUERIES = 512  # queries of a block
SLICE = 64  # queries whose scores are held at once

BLOCK = "n long, ids binary, width long, weights binary"


def integer_weights(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of every component as a long; null for a vector that takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def pack(rows: DataFrame, size: int) -> DataFrame:
    """id, w -> blocks of up to `size` rows as bytes."""

    def run(batches):
        ids, vecs = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            flat, ends = b.column(1).flatten().to_numpy(zero_copy_only=False), b.column(1).offsets.to_numpy()
            base = ends[0]
            vecs += [flat[a - base : z - base] for a, z in zip(ends, ends[1:], strict=False)]
            while len(ids) >= size:
                yield _block(ids[:size], vecs[:size])
                ids, vecs = ids[size:], vecs[size:]
        if ids:
            yield _block(ids, vecs)

    return rows.mapInArrow(run, BLOCK)


def _block(ids, vecs) -> pa.RecordBatch:
    width = max((len(v) for v in vecs), default=0)
    out = np.zeros((len(ids), width), np.int64)
    for i, v in enumerate(vecs):
        out[i, : len(v)] = v
    if out.size and -(2**31) <= out.min() and out.max() < 2**31:
        out = out.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([width], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["n", "ids", "width", "weights"])


def _open(n: int, ids: bytes, width: int, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int64 if len(weights) >= 8 * n * width else np.int32
    return np.frombuffer(ids, np.int64), np.frombuffer(weights, kind).reshape(n, width)


def kind_of(q: np.ndarray, c: np.ndarray) -> type:
    """The fastest type that holds every partial sum of scores exactly."""
    most = lambda x: max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    bound = most(q) * most(c) * max(1, min(q.shape[1], c.shape[1]))
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object


def postings(c: np.ndarray, kind: type) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term its rows and their weights; rows are None where the weights stand in an array over all rows."""
    out = []
    for t in range(c.shape[1]):
        column = c[:, t].astype(kind)
        at = np.flatnonzero(c[:, t])
        out.append((None, column) if 4 * len(at) > len(column) else (at, column[at]))
    return out


def accumulate(q: np.ndarray, lists: list[tuple[np.ndarray | None, np.ndarray]], rows: int, kind: type) -> np.ndarray:
    """Dense scores of some queries over a block of `rows` rows: each term scatters its postings times the queries' weights."""
    scores = np.zeros((len(q), rows), kind)
    held = np.empty_like(scores)
    for t in range(min(q.shape[1], len(lists))):
        at, weights = lists[t]
        has = np.flatnonzero(q[:, t])
        if not len(has) or not len(weights):
            continue
        if at is None and 4 * len(has) > len(q):
            scores += np.multiply.outer(q[:, t].astype(kind), weights, out=held)
        elif at is None:
            scores[has] += np.multiply.outer(q[has, t].astype(kind), weights)
        else:
            scores[np.ix_(has, at)] += np.multiply.outer(q[has, t].astype(kind), weights)
    return np.clip(scores, -(2**63), 2**63 - 1).astype(np.int64) if kind is object else scores.astype(np.int64)


def _best(s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best: selection by partition, ties at the edge by smaller id."""
    if len(s) > k:
        edge = np.partition(s, len(s) - k)[len(s) - k]
        over, level = s > edge, s == edge
        room = k - int(over.sum())
        tied = np.sort(i[level], kind="stable")[:room]
        s, i = np.concatenate([s[over], np.full(len(tied), edge, s.dtype)]), np.concatenate([i[over], tied])
    return s, i


def top_k(rows: DataFrame, is_query: Column, k: int = 20, shards: int | None = None, block: int = ROWS) -> DataFrame:
    """rows: id long, w array of long -> query_id, rank, vec_id, score. Every query against every row."""
    spark = rows.sparkSession
    usable = rows.where(F.col("w").isNotNull() & F.col("id").isNotNull()).select("id", "w")
    shards = shards or spark.sparkContext.defaultParallelism
    cands = pack(usable, block).select(*[F.col(c).alias(f"c_{c}") for c in ("n", "ids", "width", "weights")])
    cands = cands.withColumn("shard", F.pmod(F.xxhash64("c_ids"), F.lit(shards)).cast("int"))
    asked = pack(usable.where(is_query).groupBy("id").agg(F.min("w").alias("w")), QUERIES).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pairs = asked.join(cands, "shard").select("n", "ids", "width", "weights", "c_n", "c_ids", "c_width", "c_weights")

    def run(batches):
        asked_last, best = None, {}  # the query block at hand, and the best of each of its queries so far
        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(8)], strict=True):
                qid, q = _open(*row[:4])
                cid, c = _open(*row[4:])
                if row[1] != asked_last:
                    yield _scored(best)
                    asked_last, best = row[1], {}
                kind = kind_of(q, c)
                lists = postings(c, kind)
                for a in range(0, len(qid), SLICE):
                    scores = accumulate(q[a : a + SLICE], lists, len(cid), kind)
                    for j, own in enumerate(qid[a : a + SLICE].tolist()):
                        other = cid != own
                        s, i = _best(scores[j][other], cid[other], k)
                        if own in best:
                            s, i = _best(np.concatenate([best[own][0], s]), np.concatenate([best[own][1], i]), k)
                        best[own] = (s, i)
        yield _scored(best)

    small_batches(spark)
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scored(best: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    q = [np.full(len(s), own, np.int64) for own, (s, _) in best.items()]
    join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    scores = join([s for s, _ in best.values()]).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(join(q)), pa.array(join([i for _, i in best.values()]).astype(np.int64)), pa.array(scores)], names=["query_id", "vec_id", "score"])
