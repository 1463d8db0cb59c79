"""Log-likelihoods, the best segmentation of an n-gram, and the association score.

best(w) is the larger of ll(w) and the best sum over the cuts of w; the segmentation score of w is that sum without the
uncut w. Instead of two joins for every cut of every size, each n-gram looks up two others, all but its last and all but its
first token: the one brings the best of all shorter prefixes with it, the other that of all shorter suffixes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexibond.tables import Table


def with_log_likelihood(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds ln(count) - ln(total of the size). totals has a row for each size, so it is broadcast."""
    ll = F.log(F.col("count").cast("double")) - F.log(F.col("total").cast("double"))
    return counts.join(F.broadcast(totals), "n").withColumn("log_likelihood", ll).drop("total")


SINGLES = 500_000  # single tokens that are broadcast: the cap of a vocabulary


def max_segmentation(scored: DataFrame, max_size: int) -> DataFrame:
    """n >= 2 n-grams with max_segmentation_log_likelihood_sum; null where needed parts are missing from `scored`.

    scored should be a written table: each size reads its own rows of it, and is written itself."""
    sums = "max_segmentation_log_likelihood_sum"
    own = scored.where(F.col("n") == 1)
    below = Table(own.select("ngram", F.array("log_likelihood").alias("heads"), F.array("log_likelihood").alias("tails")), "best")
    few, done = below.df.count() <= SINGLES, None
    for n in range(2, max_size + 1):
        side = F.broadcast if n == 2 and few else (lambda df: df)  # the only lookup with very frequent keys
        left = side(below.df.select(F.col("ngram").alias("_head"), "heads"))
        right = side(below.df.select(F.col("ngram").alias("_tail"), "tails"))
        own = scored.where(F.col("n") == n).withColumns({"_head": F.slice("ngram", 1, n - 1), "_tail": F.slice("ngram", 2, n - 1)})
        met = own.join(left, "_head", "left").join(right, "_tail", "left")
        none = F.array(*[F.lit(None).cast("double")] * (n - 1))
        met = met.withColumns({"heads": F.coalesce("heads", none), "tails": F.coalesce("tails", none)})
        cuts = [F.col("heads")[k - 1] + F.col("tails")[n - k - 1] for k in range(1, n)]
        met = met.withColumn(sums, cuts[0] if n == 2 else F.greatest(*cuts))
        best = F.array(F.greatest("log_likelihood", sums))
        size = Table(met.select(*scored.columns, sums, F.concat("heads", best).alias("heads"), F.concat("tails", best).alias("tails")), "best")
        below = size
        rows = size.df.select(*scored.columns, sums)
        done = rows if done is None else done.unionByName(rows)
    return done


def part_condition(main: str, part: str, k: int, start: int) -> Column:
    """Equality of the k tokens of `main` from `start` (from 0) with the n-gram of `part`; both are table aliases."""
    return F.slice(F.col(f"{main}.ngram"), start + 1, k) == F.col(f"{part}.ngram")


def max_segmentation_by_splits(scored: DataFrame, max_size: int) -> DataFrame:
    """The same values size after size, with two equi-joins for each cut: shorter sizes must be done before longer ones.

    The plain form of the recursion; max_segmentation needs two joins for each size."""
    best = {1: scored.where(F.col("n") == 1).select("ngram", F.col("log_likelihood").alias("best"))}
    done = None
    for n in range(2, max_size + 1):
        own = scored.where(F.col("n") == n).withColumn("max_segmentation_log_likelihood_sum", F.lit(None).cast("double"))
        for cut in range(1, n):
            left, right = best[cut].alias("l"), best[n - cut].alias("r")
            met = own.alias("m").join(left, part_condition("m", "l", cut, 0), "left").join(right, part_condition("m", "r", n - cut, cut), "left")
            both = F.col("l.best") + F.col("r.best")
            own = met.select(*[F.col(f"m.{c}") for c in scored.columns], F.greatest(F.col("m.max_segmentation_log_likelihood_sum"), both).alias("max_segmentation_log_likelihood_sum"))
        best[n] = own.select("ngram", F.greatest("log_likelihood", "max_segmentation_log_likelihood_sum").alias("best"))
        done = own if done is None else done.unionByName(own)
    return done


def segmentations(n: int) -> list[list[tuple[int, int]]]:
    """All ways to cut n tokens into two or more parts, as (start, length) lists."""
    if n < 2:
        raise ValueError("an n-gram of fewer than two tokens has no segmentation")
    out = []
    for cuts in range(1, n):
        for at in combinations(range(1, n), cuts):
            edges = [0, *at, n]
            out.append([(a, b - a) for a, b in zip(edges, edges[1:], strict=False)])
    return out


def segmentation_rows(grams: DataFrame, n: int) -> DataFrame:
    """Each n-gram with each of its segmentations: seg_id and parts (array of arrays)."""
    every = [F.struct(F.lit(i).alias("seg_id"), F.array(*[F.slice("ngram", s + 1, k) for s, k in seg]).alias("parts")) for i, seg in enumerate(segmentations(n))]
    return grams.where(F.col("n") == n).select("ngram", F.inline(F.array(*every)))


def max_segmentation_by_force(scored: DataFrame, n: int) -> DataFrame:
    """The same value for one size by summing every segmentation; a cross-check of max_segmentation."""
    parts = segmentation_rows(scored, n).select("ngram", "seg_id", F.explode("parts").alias("part"))
    known = scored.select(F.col("ngram").alias("part"), "log_likelihood")
    sums = parts.join(known, "part").groupBy("ngram", "seg_id").agg(F.sum("log_likelihood").alias("total"))
    return sums.groupBy("ngram").agg(F.max("total").alias("max_segmentation_log_likelihood_sum"))


def association(log_likelihood: Column, max_segmentation: Column) -> Column:
    return F.lit(2.0) * log_likelihood - max_segmentation


def with_pmi(segmented: DataFrame) -> DataFrame:
    return segmented.withColumn("pmi_score", association(F.col("log_likelihood"), F.col("max_segmentation_log_likelihood_sum")))


def scores(counts: DataFrame, totals: DataFrame, max_size: int) -> DataFrame:
    """n >= 2 n-grams with count, log_likelihood, max_segmentation_log_likelihood_sum and pmi_score."""
    likely = Table(with_log_likelihood(counts, totals), "likelihood")
    return with_pmi(max_segmentation(likely.df, max_size))
