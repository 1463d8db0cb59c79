"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Weights are turned into target sizes; no source is taken more than MOST times, and what that cuts off is shared out
again by weight. Documents fall into blocks of their source by a keyed hash, and each source's blocks are put into a keyed
random order. A source is taken whole as often as its target holds it; of the rest, blocks are taken in that order, and
within the block where the target ends, documents in their own keyed order. Thus every source has an exact quota of
blocks. A binary tree divides these quotas over the output shards: a node with capacities for its two halves draws the
left half's count of each source from the multivariate hypergeometric law (source after source, by inverting the exact
distribution at a keyed uniform). The leaves' quotas are filled with disjoint runs of each source's permuted blocks, and
each shard is shuffled locally by a keyed order.

Only DataFrame functions; texts aren't shuffled, only ids and sizes. Windows over documents are within a block, windows
over blocks within a source of at most BLOCKS blocks; nothing is gathered by source.

A null text has size 0; documents of size 0 are never taken. A null source is a source, the last. Rows with equal ids and
texts share a block and are ordered as equals; each counts. A table without words gives targets and takes of 0; an empty
table gives no rows. Documents are taken whole, so a source's taken size is within half a document of its target."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexibond.llm.shared import WORD, Table

BLOCKS = 1 << 20  # of a source at most
PER_BLOCK = 256  # documents of a block, about, while there are fewer blocks than that
WORDS_PER_SHARD = 8_000_000
LEAST_SHARDS = 8
MOST = 2.0
SHARE = 1.5
WEIGHTS = (3.0, 1.0, 2.0)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keyed(seed: int, tag: str, *cols: Column | str) -> Column:
    """A uniform 64-bit number that only depends on the seed and the columns."""
    return F.xxhash64(F.lit(f"{seed}:{tag}"), *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("\x00")) for c in cols])


def document_key(seed: int = 0) -> Column:
    """A document's key: equal for rows of equal id and text."""
    return keyed(seed, "doc", "doc_id", "text")


def unit(hashed: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / float(2**53)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources: source, source_size -> with target. Weights go round the sources in code point order, null last.

    Sharing again what capped sources leave comes to one level: sources are capped in order of cap by weight, as long as
    the level (what is left by the weight that is left) is above theirs. One row for each source is sorted here."""
    order = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    base = sources.withColumn("weight", weight).withColumn("cap", cap)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    capped = base.withColumn("own_level", level).withColumn("is_capped", F.col("cap") < F.col("own_level") * F.col("weight"))
    # Once a source isn't capped, none after it is: its level is everyone's.
    final = F.min(F.when(~F.col("is_capped"), F.struct(F.col("cap") / F.col("weight"), F.col("own_level").alias("l")))).over(Window.partitionBy(F.lit(1)))
    target = F.when(F.col("is_capped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * final["l"]))
    return capped.select("source", "source_size", "n_docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def plan(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs: doc_id, source, text (others are left out) -> doc_id, source, size, source_size, target, copies, block, key.

    copies: how often the mix takes the document. The block in which a target ends is one list for each source."""
    sized = Table(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), document_key(seed).alias("key")), "mix-sizes").df
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goal = targets(sources, weights, share, most).withColumns({
        "whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
        "n_blocks": F.least(F.ceil(F.col("n_docs") / PER_BLOCK), F.lit(BLOCKS)),
    })
    goal = Table(goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-goal").df
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    dealt = sized.alias("d").join(goal.alias("g"), same("d", "g")).select("d.*", "source_size", "target", "whole", "rest", F.pmod("key", "n_blocks").alias("block"))
    blocks = dealt.groupBy("source", "block", "rest").agg(F.sum("size").alias("block_size"))
    line = Window.partitionBy("source").orderBy(keyed(seed, "block", "source", "block"), "block")
    blocks = blocks.withColumns({"before": F.coalesce(F.sum("block_size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    blocks = blocks.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "before", "block_size")
    joined = dealt.join(blocks, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block"))).drop("b_source", "b_block")
    placed = Table(joined.withColumn("place", F.row_number().over(Window.partitionBy("source", "block").orderBy("key", "doc_id", "size"))), "mix-placed").df
    cut = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("block_size") > F.col("rest"))
    room = (F.first("rest") - F.first("before")).cast("double")
    edge = placed.where(cut).groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("place", "size"))).alias("line"), room.alias("room"))
    fill = F.aggregate("line", F.struct(F.col("room").alias("room"), F.array().cast("array<int>").alias("out")), _fit, lambda acc: acc["out"])
    filled = edge.select(F.col("source").alias("f_source"), F.col("block").alias("f_block"), F.explode(fill).alias("f_place"))
    on = F.col("source").eqNullSafe(F.col("f_source")) & (F.col("block") == F.col("f_block")) & (F.col("place") == F.col("f_place"))
    whole_block = F.col("before") + F.col("block_size") <= F.col("rest")
    more = (whole_block | F.col("f_place").isNotNull()).cast("long")
    copies = F.when(F.col("size") > 0, F.least(F.col("whole") + more, F.lit(int(most)))).otherwise(0)
    return placed.join(filled, on, "left").select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), "block", "key")


def _fit(acc: Column, x: Column) -> Column:
    """Takes a document of the block in which the target ends, if there is room for it."""
    fits = x["size"] <= acc["room"]
    return F.struct((acc["room"] - F.when(fits, x["size"]).otherwise(0)).alias("room"), F.when(fits, F.concat(acc["out"], F.array(x["place"]))).otherwise(acc["out"]).alias("out"))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(total: Column, good: Column, drawn: Column, uniform: Column) -> Column:
    """How many of `good` items are among `drawn` out of `total`: the exact distribution, inverted at `uniform`.

    Works over 12 deviations on both sides of the mean (what lies beyond weighs less than 1e-30)."""
    t, g, d = (x.cast("double") for x in (total, good, drawn))
    mean = F.when(t > 0, d * g / t).otherwise(F.lit(0.0))
    spread = F.when(t > 1, F.sqrt(F.greatest(d * (g / t) * (1 - g / t) * (t - d) / (t - 1), F.lit(0.0)))).otherwise(F.lit(0.0))
    low = F.greatest(F.lit(0.0), d + g - t, F.floor(mean - 12 * spread - 2).cast("double")).cast("long")
    high = F.least(g, d, F.ceil(mean + 12 * spread + 2).cast("double")).cast("long")
    return _let(F.struct(t.alias("t"), g.alias("g"), d.alias("d"), low.alias("low"), F.greatest(low, high).alias("high"), uniform.alias("u")), _invert)


def _invert(v: Column) -> Column:
    """Logs of the probabilities relative to the lowest place, their top, their sum, and where the share u is reached."""
    steps = F.sequence(v["low"], v["high"])
    ratio = lambda k: ((v["g"] - k) * (v["d"] - k)) / ((k + 1) * (v["t"] - v["g"] - v["d"] + k + 1))
    log_next = lambda log, k: log + F.log(F.greatest(ratio(k.cast("double")), F.lit(1e-300)))
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("best"))
    top = F.aggregate(steps, start, lambda a, k: F.struct(log_next(a["log"], k).alias("log"), F.greatest(a["best"], a["log"]).alias("best")), lambda a: a["best"])

    def with_top(m: Column) -> Column:
        first = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
        every = F.aggregate(steps, first, lambda a, k: F.struct(log_next(a["log"], k).alias("log"), (a["sum"] + F.exp(a["log"] - m)).alias("sum")), lambda a: a["sum"])

        def with_sum(total: Column) -> Column:
            begin = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("found"))

            def go(a: Column, k: Column) -> Column:
                share = a["sum"] + F.exp(a["log"] - m)
                return F.struct(log_next(a["log"], k).alias("log"), share.alias("sum"), F.when((a["found"] < 0) & (share >= v["u"] * total), k).otherwise(a["found"]).alias("found"))

            return F.aggregate(steps, begin, go, lambda a: F.when(a["found"] < 0, v["high"]).otherwise(a["found"]))

        return _let(every, with_sum)

    return _let(top, with_top)


def _with_tag(draw, tag: str):
    return lambda acc, x: draw(acc, x, tag)


def split_tree(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """quotas: source, quota (blocks) -> source, shard, quota. One row for each source and node at every level."""
    depth = max(0, ceil(log2(shards)))
    nodes = quotas.select("source", F.lit(0).cast("long").alias("node"), F.col("quota").cast("long").alias("quota"))
    for level in range(depth):
        packed = nodes.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("z"), "source", "quota"))).alias("rows"), F.sum("quota").alias("total"))
        tag = f"draw{level}"
        half = F.floor((F.col("total") + F.pmod(keyed(seed, f"half{level}", "node"), F.lit(2))) / 2)
        packed = packed.withColumn("half", half)

        def draw(acc: Column, x: Column, tag: str) -> Column:
            left = hypergeometric(acc["total"], x["quota"], acc["drawn"], unit(keyed(seed, tag, F.col("node"), x["source"])))
            row = lambda v: F.array(F.struct(x["source"].alias("source"), v.alias("left"), (x["quota"] - v).alias("right")))
            return _let(left, lambda v: F.struct((acc["total"] - x["quota"]).alias("total"), (acc["drawn"] - v).alias("drawn"), F.concat(acc["out"], row(v)).alias("out")))

        start = F.struct(F.col("total"), F.col("half").cast("long").alias("drawn"), F.expr("cast(array() as array<struct<source:string,left:bigint,right:bigint>>)").alias("out"))
        done = packed.select("node", F.inline(F.aggregate("rows", start, _with_tag(draw, tag), lambda acc: acc["out"])))
        left = done.select("source", (F.col("node") * 2).alias("node"), F.col("left").alias("quota"))
        right = done.select("source", (F.col("node") * 2 + 1).alias("node"), F.col("right").alias("quota"))
        nodes = Table(left.unionByName(right), "mix-nodes").df
    return nodes.select("source", F.col("node").alias("shard"), "quota").where(F.col("quota") > 0)


def mix(docs: DataFrame, shards: int | None = None, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, key (document_key) and `copies`, an array of (copy, shard, order)
    with an entry for every time that an output shard draws it; expand() makes a row of each. Without a number of shards, one
    has about WORDS_PER_SHARD words, but there are LEAST_SHARDS at least."""
    planned = Table(plan(docs, seed, weights, share, most), "mix-plan").df
    if shards is None:
        words = planned.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
        shards = max(LEAST_SHARDS, ceil(words / WORDS_PER_SHARD))
    taken = planned.where(F.col("copies") > 0).select("source", "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    units = taken.groupBy("source", "copy", "block").agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy("source").orderBy(keyed(seed, "unit", "source", "copy", "block"), "copy", "block")
    units = Table(units.withColumn("spot", F.row_number().over(line)), "mix-units").df
    quotas = units.groupBy("source").agg(F.count(F.lit(1)).alias("quota"))
    leaves = split_tree(quotas, shards, seed)
    runs = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    leaves = leaves.withColumn("upto", F.sum("quota").over(runs)).select(F.col("source").alias("l_source"), "shard", F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))).alias("l_spot"))
    homed = units.join(leaves, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("spot") == F.col("l_spot")))
    homes = homed.groupBy(F.col("source").alias("u_source"), F.col("block").alias("u_block")).agg(F.collect_list(F.struct("copy", "shard")).alias("homes"))
    on = F.col("source").eqNullSafe(F.col("u_source")) & (F.col("block") == F.col("u_block"))
    own = F.filter(F.coalesce("homes", F.array().cast("array<struct<copy:bigint,shard:bigint>>")), lambda h: h["copy"] <= F.col("copies"))
    placed = F.transform(F.sort_array(own), lambda h: F.struct(h["copy"].alias("copy"), h["shard"].alias("shard"), keyed(seed, "order", F.col("key"), h["copy"]).alias("order")))
    return planned.join(homes, on, "left").select("doc_id", "source", "size", "source_size", "target", "key", placed.alias("copies"))


def expand(mixed: DataFrame) -> DataFrame:
    """Every copy: doc_id, source, size, key, copy, shard, order. Dealt by shard and sorted by order, a shard is shuffled."""
    return mixed.select("doc_id", "source", "size", "key", F.inline("copies"))
