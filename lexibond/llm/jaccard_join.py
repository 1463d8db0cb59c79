"""N-gram Jaccard join by parity sketches.

A document is the set of its k-word shingles. In a parity sketch every shingle flips one bit, so the Hamming distance of
two sketches is at most the size of the sets' symmetric difference. Two sets of similarity t or more have sizes within a
factor t and differ in at most (1 - t) / (1 + t) of the sum of their sizes; so within a band of sizes a bound d holds for
all pairs. A sketch is divided into more than d parts; the pigeonhole says that similar sets agree on a whole part. Parts
are joined by (band, part, bits); each set stands in the parts of its own band and of the next, where it may meet larger
sets. Empty parts aren't joined: there are enough parts that a set has more than d filled ones, and the rare set that
doesn't goes to a part of its own for such sets, so that none is lost.

Sets that are equal are one node from the start (local copies are dropped before the shuffle), so copies never meet as
pairs. Only nodes that agree on a part are compared, and only what is verified on the sets themselves is a link:

1. Every part's nodes are compared with its smallest node: sketches by their Hamming distance, short ones, then long ones
   whose length follows the set's, then the sets. Links give components, so a large group of near copies is mostly one component now.
2. Of the parts that still hold several components, the other nodes are compared by their sketches, a part in blocks of
   BLOCK nodes, two blocks in a task, and only across components. A block pair gives a spanning forest over components of
   what the short sketches allow, nearest first; long sketches and the sets decide.
3. The same once more, now with every pair that the sketches allow and that is still apart. What passes here without
   being a link has to be verified by any exact method.

Nulls and texts without words have the empty set and are linked with nothing. Every row gives one row; rows of one id are
linked only through their sets. A null id is its own component unless its set is shared. Ties don't matter, other columns
are left out, an empty table gives no rows."""

from __future__ import annotations

from functools import reduce
from math import exp

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibond.llm.components import components
from lexibond.llm.shared import Table, hot_keys, lookup, mix64, shingle_set, small_batches

_FLIP = np.uint64(0x51ED270B)  # a part of a sketch has 2^64 bits, of which a member flips one
LONGEST = 1 << 40
BLOCK = 256  # nodes of a block
SPARE, LEAST_BITS, MOST_BITS = 16, 256, 1024  # of a short sketch, bits: for each element in which similar sets may differ, and bounds
SPARE_LONG = 4  # the same for a long sketch, which has no bound: noise is less where more may differ
REMEMBERED = 500_000  # nodes a task remembers to drop local copies
SLOTS = 256  # tasks over which the partners of a node are dealt, if it has many
BROADCAST = 500_000  # rows of three numbers


class Bands:
    """Bands of set sizes for a similarity of num/den, and the number of parts in each."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        low = [1]
        while low[-1] < LONGEST:
            low.append(max(low[-1] + 1, -(-low[-1] * den // num)))
        self.low = np.array(low)
        t = num / den
        # parts for each allowed difference, so that the smallest set of a band fills more parts than differ
        per = t * t * (1 + t) / (2 * (1 - t)) if t < 1 else 1e9
        self.factor = 1.02
        while self.factor * (1 - exp(-per / self.factor)) < 1.03 and self.factor < 4:
            self.factor += 0.02

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def differ(self, n: int, m: int) -> int:
        """Most elements in which similar sets of n and m members differ."""
        return (n + m) * (self.den - self.num) // (self.den + self.num)

    def parts(self, band: int) -> int:
        top = int(self.low[band + 1]) - 1
        return int(self.factor * (self.differ(top, top) + 1)) + 3


def sketch_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The join keys of a set: hashes of (band, part, parity bits) of filled parts, in its own and the next band.

    In a band, the set differs from any similar one in `differ` parts at most, so its first differ + 1 filled parts do: the
    shorter of two such beginnings has a part in which both agree."""
    out = []
    n, own = len(s), bands.of(len(s))
    flips = mix64(s + _FLIP)  # a linear hash of the bits of a part: the XOR of those set
    for band in (own, own + 1):
        if band > own and n * bands.den < bands.num * int(bands.low[band]):
            continue
        p, differ = bands.parts(band), bands.differ(n, min(int(bands.low[band + 1]) - 1, n * bands.den // bands.num))
        part = ((s >> np.uint64(20)) % np.uint64(p)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sorted_part = part[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_part[1:] != sorted_part[:-1]]))
        bits = np.bitwise_xor.reduceat(flips[order], first)
        filled = np.flatnonzero(bits)
        where = sorted_part[first][filled[: differ + 1]].astype(np.uint64)
        out.append(mix64(mix64(bits[filled[: differ + 1]] + where * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(band + 1)))
        if len(filled) <= differ:
            out.append(mix64(np.array([band + 1], np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return np.concatenate(out)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether 100 % * intersection / union of two sorted sets is at least num/den; sizes first."""
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def node_of(s: np.ndarray) -> int:
    """One number for a set: equal sets have equal numbers."""
    if not len(s):
        return 0
    h = mix64(np.array([mix64(s).sum(dtype=np.uint64) + np.uint64(len(s)), np.bitwise_xor.reduce(mix64(s + np.uint64(0xABCD)))], np.uint64))
    return int((h[0] ^ (h[1] << np.uint64(1))).astype(np.int64))


def parity_sketch(s: np.ndarray, bits: int) -> int:
    """A number of `bits` bits (a power of two); every member flips one. Folding it by XOR gives the sketch of half as many."""
    odd = np.bincount((mix64(s ^ np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return int.from_bytes(np.packbits(odd.astype(bool), bitorder="little").tobytes(), "little")


def sketches(s: np.ndarray, num: int, den: int) -> tuple[bytes, bytes]:
    """A set's short sketch, which many may be compared by, and its long one, whose size follows the set's."""
    differ = 2 * len(s) * (den - num) // (den + num)
    size = lambda spare: 1 << max(0, spare * differ - 1).bit_length()
    short = min(MOST_BITS, max(LEAST_BITS, size(SPARE)))
    long = max(short, size(SPARE_LONG))
    out = parity_sketch(s, long).to_bytes(long // 8, "little")
    return folded(out, short // 8), out


def folded(sketch: bytes, size: int) -> bytes:
    """The sketch of `size` bytes from a longer one."""
    x = int.from_bytes(sketch, "little")
    n = len(sketch)
    while n > size:
        n //= 2
        x = (x >> (8 * n)) ^ (x & ((1 << (8 * n)) - 1))
    return x.to_bytes(size, "little")


def may_link(n: int, a: bytes, m: int, b: bytes, num: int, den: int) -> bool:
    """Whether sets of n and m members with these sketches may be similar: sizes and Hamming distance."""
    if min(n, m) * den < num * max(n, m):
        return False
    size = min(len(a), len(b))
    apart = (int.from_bytes(folded(a, size), "little") ^ int.from_bytes(folded(b, size), "little")).bit_count()
    return apart * (den + num) <= (n + m) * (den - num)


# Rows of the first pass: a document (key is only there to deal rows out, n isn't null) or a sketch key of a node.
ROWS = "key long, node long, n long, doc long, hash long, short binary, long binary"
_NAMES = ["key", "node", "n", "doc", "hash", "short", "long"]
# After the keys are sorted: a document (key is null), or a node of a key that two or more have, with the key's smallest
# node; wide is false only where the key surely has just two nodes.
FOUND = "key long, node long, n long, doc long, hash long, short binary, long binary, centre long, wide boolean"


def _spread(docs: DataFrame, k: int, bands: Bands) -> DataFrame:
    """Documents, and the sketch keys of their nodes, in one pass over the texts."""

    def run(batches):
        seen: set[int] = set()
        done = (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0  # deals documents out, alike at every retry
        for rows in batches:
            ids, texts = rows.column(0), rows.column(1).to_pylist()
            nodes, sizes, drawn, keys, owners = [], [], [], [], []
            for t in texts:
                s = shingle_set((t or "").encode(), k)
                node = node_of(s)
                nodes.append(node)
                sizes.append(len(s))
                drawn.append(sketches(s, bands.num, bands.den) if len(s) else (None, None))
                if len(s) and node not in seen:
                    if len(seen) >= REMEMBERED:
                        seen = set()
                    seen.add(node)
                    own = sketch_keys(s, bands)
                    keys.append(own)
                    owners.append(np.full(len(own), node, np.int64))
            dealt = mix64(np.arange(done, done + len(texts), dtype=np.uint64)).view(np.int64)
            done += len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(dealt), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), ids, rows.column(2), *[pa.array([x[i] for x in drawn], pa.binary()) for i in (0, 1)]], names=_NAMES)
            if keys:
                flat, own = np.concatenate(keys).view(np.int64), np.concatenate(owners)
                for at in range(0, len(flat), 200_000):
                    part = flat[at : at + 200_000]
                    none = pa.nulls(len(part), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(own[at : at + 200_000]), none, none, none, *[pa.nulls(len(part), pa.binary())] * 2], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash")).mapInArrow(run, ROWS)


def _found(columns: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    size = max(len(c) for c in columns if c is not None)
    arrays = [pa.nulls(size, t) if c is None else pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[*_NAMES, "centre", "wide"])


def _shared(spread: DataFrame) -> DataFrame:
    """Documents, and the keys that two or more nodes have. Rows come sorted by key and node, so little is held."""

    def run(batches):
        last_key, last_node, first_node, size = None, None, None, 0  # the open key: its last and first node, its nodes so far
        for rows in batches:
            key, node = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            is_doc = rows.column(2).is_valid().to_numpy(zero_copy_only=False)
            if is_doc.any():
                mine = rows.filter(pa.array(is_doc))
                yield _found([None, *[mine.column(i) for i in range(1, 7)], None, None])
                key, node = key[~is_doc], node[~is_doc]
            if not len(key):
                continue
            goes_on = last_key is not None and key[0] == last_key
            fresh = np.concatenate([[not (goes_on and node[0] == last_node)], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            key, node = key[fresh], node[fresh]
            if not len(key):
                continue
            goes_on = last_key is not None and key[0] == last_key
            if last_key is not None and not goes_on:
                size = 0
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            run_of = np.repeat(np.arange(len(edge)), np.diff(np.concatenate([edge, [len(key)]])))
            here = np.bincount(run_of)
            centre = node[edge]
            before = np.zeros(len(edge), np.int64)
            if goes_on:
                centre[0], before[0] = first_node, size
            total = here + before
            out = total[run_of] >= 2
            wide = total >= 3
            wide[-1] = True  # more may follow
            if goes_on and size == 1 and out[0]:  # the open key's first node, kept back until a second came
                yield _found([[int(key[0])], [int(first_node)], None, None, None, None, None, [int(first_node)], [bool(wide[0])]])
            last_key, last_node, first_node, size = int(key[-1]), int(node[-1]), int(centre[-1]), int(total[-1])
            if out.any():
                yield _found([key[out], node[out], None, None, None, None, None, centre[run_of][out], wide[run_of][out]])

    return spread.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, FOUND)


def _plausible(pairs: DataFrame, nodes: DataFrame, sketch: str, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b; a written table) whose sketches, short or long, allow a link."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.struct("n", sketch).alias(f"of_{c}"))
    hubs = hot_keys(pairs, "a")
    often = F.col("a").isin(hubs) if hubs else F.lit(False)
    ends = pairs.join(side("b"), "b")
    both = ends.where(~often).join(side("a"), "a")
    if hubs:
        both = both.unionByName(ends.where(often).join(F.broadcast(side("a").where(often)), "a"))

    def run(batches):
        for rows in batches:
            sides = [rows.column(i).to_pylist() for i in (2, 3)]
            ok = [may_link(x["n"], x[sketch], y["n"], y[sketch], num, den) for x, y in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> Table:
    """Those of the pairs (a, b; a written table) that are links: first by long sketches, then by the sets of one document
    of each node. A task holds the set of a and sees one partner at a time; partners of a node that has many are dealt over
    SLOTS tasks."""
    likely = Table(_plausible(pairs, nodes, "long", num, den), "jaccard-likely")
    wanted = likely.df.select(F.col("a").alias("node")).unionByName(likely.df.select(F.col("b").alias("node"))).distinct()
    wanted = Table(wanted.join(nodes, "node").select("node", "doc", "hash"), "jaccard-wanted")
    named = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("th"))
    asked = F.broadcast(wanted.df) if wanted.df.count() <= BROADCAST else wanted.df
    one = named.join(asked, (F.col("th") == F.col("hash")) & F.col("id").eqNullSafe(F.col("doc"))).select("node", "text")
    texts = Table(one.dropDuplicates(["node"]), "jaccard-texts")  # rows may be repeated
    hubs = hot_keys(likely.df, "a")
    slot = F.pmod(F.xxhash64("b"), F.lit(SLOTS))
    dealt = likely.df.withColumn("slot", (F.when(F.col("a").isin(hubs), slot).otherwise(0) if hubs else F.lit(0)).cast("int"))
    members = dealt.join(texts.df.withColumnRenamed("node", "b"), "b").select("a", "slot", "b", "text")
    centres = dealt.select("a", "slot").distinct().join(texts.df.withColumnRenamed("node", "a"), "a").select("a", "slot", F.lit(None).cast("long").alias("b"), "text")
    rows = centres.unionByName(members).repartition("a", "slot").sortWithinPartitions("a", "slot", F.asc_nulls_first("b"))

    def run(batches):
        held = None
        for batch in batches:
            found = []
            for a, b, text in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)], strict=True):
                s = shingle_set((text or "").encode(), k)
                if b is None:
                    held = s
                elif similar(held, s, num, den):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    links = Table(rows.mapInArrow(run, "a long, b long"), "jaccard-links")
    for table in (likely, wanted, texts):
        table.drop()
    return links


def across(nodes: np.ndarray, labels: np.ndarray, sizes: np.ndarray, sketches: list[bytes], left: np.ndarray, num: int, den: int, every: bool) -> list[tuple[int, int]]:
    """Pairs of nodes with different labels whose sketches allow a link: of the left nodes with the others, or among all if
    all are left. every: all such pairs, else a forest over labels of the nearest."""
    size = min(len(x) for x in sketches)
    bits = np.frombuffer(b"".join(folded(x, size) for x in sketches), np.uint64).reshape(len(sketches), size // 8)
    a_side = np.flatnonzero(left)
    b_side = a_side if left.all() else np.flatnonzero(~left)
    near = []
    for i in a_side:
        other = b_side[b_side > i] if left.all() else b_side
        low, high = np.minimum(sizes[i], sizes[other]), np.maximum(sizes[i], sizes[other])
        other = other[(low * den >= high * num) & (labels[other] != labels[i])]
        distance = np.bitwise_count(bits[i] ^ bits[other]).sum(axis=1, dtype=np.int64)
        ok = distance * (den + num) <= (sizes[i] + sizes[other]) * (den - num)
        near += [(int(d), int(i), int(j)) for d, j in zip(distance[ok], other[ok], strict=True)]
    pair = lambda i, j: (int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j])))
    if every:
        return [pair(i, j) for _, i, j in near]
    out, parent = [], {}

    def root(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    for _, i, j in sorted(near):
        x, y = root(int(labels[i])), root(int(labels[j]))
        if x != y:
            parent[x] = y
            out.append(pair(i, j))
    return out


def _rest(shared: DataFrame, labels: DataFrame, nodes: DataFrame, num: int, den: int, every: bool) -> Table:
    """Pairs to verify across the components that still share a key; see across()."""
    others = shared.where(F.col("wide") & (F.col("node") != F.col("centre"))).select("key", "node")
    told = others.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    told = Table(told, "jaccard-told")
    keys = told.df.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("rows")).where("x <> y")
    keys = Table(keys.select("key", F.ceil(F.col("rows") / BLOCK).cast("long").alias("blocks")), "jaccard-open")
    live = lookup(told.df, "key", keys.df).where(F.col("blocks").isNotNull())
    block = F.pmod(F.xxhash64("node"), "blocks")
    met = live.withColumn("block", block).select("key", "node", "label", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with"))
    lo, hi = F.least("block", "with"), F.greatest("block", "with")
    tasks = met.select("node", "label", F.xxhash64("key", lo, hi).alias("task"), (F.col("block") == lo).alias("first"))
    rows = tasks.join(nodes.select("node", "n", "short"), "node").repartition("task").sortWithinPartitions("task", "node").select("task", "node", "label", "n", "short", "first")

    def one(held: list):
        if len(held) > 1:
            node, label, n, short, first = zip(*held, strict=True)
            found = across(np.array(node), np.array(label), np.array(n), list(short), np.array(first), num, den, every)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    def run(batches):
        task, held = None, []
        for batch in batches:
            for t, *row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if t != task:
                    yield from one(held)
                    task, held = t, []
                held.append(row)
        yield from one(held)

    pairs = Table(rows.mapInArrow(run, "a long, b long").distinct(), "jaccard-rest")
    told.drop()
    keys.drop()
    return pairs


def _linked(found: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> Table:
    """node, label of all nodes that have a verified link; the label is the component's smallest node."""
    shared = found.where(F.col("key").isNotNull())
    stars = Table(shared.where(F.col("node") != F.col("centre")).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "jaccard-stars")
    likely = Table(_plausible(stars.df, nodes, "short", num, den), "jaccard-near")
    stars.drop()
    links = [_verified(likely.df, docs, nodes, k, num, den)]
    likely.drop()
    labels = components(links[0].df)
    for every in (False, True):
        pairs = _rest(shared, labels.df, nodes, num, den, every)
        none = pairs.df.isEmpty()
        if not none:
            links.append(_verified(pairs.df, docs, nodes, k, num, den))
            if not links[-1].df.isEmpty():
                labels.drop()
                labels = components(reduce(DataFrame.unionByName, [x.df for x in links]))
        pairs.drop()
        if none:
            break
    for table in links:
        table.drop()
    return labels


def near_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs: doc_id, text -> doc_id, n_shingles, component_id: the smallest id reachable by links of similarity num/den.

    keep: further columns, hash (of the text) and label (one for each component of rows that have shingles)."""
    small_batches(docs.sparkSession)
    found = Table(_shared(_spread(docs, k, Bands(num, den))), "jaccard")
    known = found.df.where(F.col("key").isNull()).select("doc", F.col("n").alias("n_shingles"), "node", "hash", "n", "short", "long")
    one = F.min(F.struct("doc", "hash"))
    nodes = known.where(F.col("n") > 0).groupBy("node").agg(one.alias("one"), F.min("doc").alias("low"), F.min("n").alias("n"), F.min("short").alias("short"), F.min("long").alias("long"))
    nodes = Table(nodes.select("node", "one.doc", "one.hash", "low", "n", "short", "long"), "jaccard-nodes")
    labels = _linked(found.df, docs, nodes.df, k, num, den)
    lowest = Table(labels.df.join(nodes.df.select("node", "low"), "node").groupBy("label").agg(F.min("low").alias("all")), "jaccard-lowest")
    named = Table(lookup(labels.df, "label", lowest.df), "jaccard-named")
    final = nodes.df.select("node", "low").join(named.df, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.when(F.col("label").isNull(), F.col("low")).otherwise(F.col("all")).alias("low"))
    people = known.where(F.col("n") > 0).select("doc", "n_shingles", "node", "hash")
    told = lookup(people, "node", final).select(F.col("doc").alias("doc_id"), "n_shingles", F.col("low").alias("component_id"), "hash", "label")
    bare = known.where(F.col("n") == 0).select(F.col("doc").alias("doc_id"), "n_shingles", F.col("doc").alias("component_id"), "hash", F.col("node").alias("label"))
    done = Table(told.unionByName(bare).select("doc_id", "n_shingles", "component_id", *keep), "jaccard-components")
    for table in (found, nodes, labels, lowest, named):
        table.drop()
    return done.df
