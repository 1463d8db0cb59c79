"""Quality rules: base rules and robust multivariate outliers.

Each document's statistics are counted over its whole text; those that pass the base rules are transformed into vectors.
For each language and source a minimum-covariance-determinant estimate is made, by deterministic starts: medians and
median deviations give scales, and four correlations are tried with them (none; of tanh of the standardised values; of their
spatial signs; of the half nearest to the medians). From each start, concentration steps refit mean and covariance to the
KEPT share of documents of smallest distance as long as that makes the determinant smaller by TOLERANCE or more; the fit of
the smallest determinant is taken and reweighted: mean and covariance of all documents within its WITHIN quantile. A document whose
squared Mahalanobis distance is beyond the CUTOFF quantile of the chi-square law is rejected.

Covariances are regularised as in the minimum regularised covariance determinant: a group's is mixed with the diagonal one of
all documents' median deviations, which counts as much as RIDGE documents. So every group has a fit of its own, by one rule
whatever its size; in a group of few documents the mixture keeps the fit wide.

Only DataFrame functions. Statistics are written once; every step is an aggregate by group and start of that small table,
partial before its shuffle, and texts are never shuffled. Quantiles are read from counts of values on a grid, at most a few
thousand for a group, so reruns agree.

A null text has no words and fails the base rules; null languages and sources are groups of their own. Every row gives one
row and is judged alike whether repeated or not; other columns are left out, an empty table gives no rows. A group all of
whose documents fail the base rules has no fit (d2 null)."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexibond.llm.shared import WORD, Table

WINDOW = 5
LEAST_WORDS = 10
REPEATED_PERCENT = 20
KEPT = 0.75  # share of a group that an estimate is fitted to
TOLERANCE = 0.01  # of a determinant's logarithm
STEPS = 50  # at most
RIDGE = 12.0  # documents
FILES = 8  # of tables with a row for each group
WITHIN = 0.975
CUTOFF = 1 - 1e-6
FLOOR = 0.06  # least deviation of a component, so that constant components don't make a covariance singular
GRID = 100.0  # values are put on a grid of 1/GRID for quantiles, distances on one of 1/GRID of their logarithm

COMPONENTS = ("log_words", "log_length", "symbols", "duplicates", "repeats", "capitals")


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals.

    Arrays that lambdas index are columns of an earlier projection that is read more than once, so they're made once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(*keep, text.alias("t")).withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    words = words.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    hashed = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    one = words.select(
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^A-Z]++", "")).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashed.alias("h"),
    )
    rest = [c for c in one.columns if c != "h"]
    found = one.select(*rest, F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))).alias("s"))
    same = lambda x, j: (x["v"] == F.get("s", j - 1)["v"]) | (x["v"] == F.get("s", j + 1)["v"])
    marks = F.transform("s", lambda x, j: F.when(F.coalesce(same(x, j), F.lit(False)), x["i"]))
    spots = found.select(*rest, F.sort_array(F.filter(marks, lambda i: i.isNotNull())).alias("p"))
    reach = F.aggregate(F.transform("p", lambda v, j: F.least(F.lit(WINDOW), F.coalesce(F.get("p", j + 1) - v, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return spots.select(*rest, F.when(F.size("p") > 0, reach).otherwise(0).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def vectors() -> dict[str, Column]:
    """The transformed statistics: logs, shares and a root, so that bulk values are near normal."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "log_words": F.log1p("n_words") / 2,
        "log_length": F.log(F.greatest(per("word_chars", "n_words"), F.lit(0.5))),
        "symbols": F.log1p(per("n_symbols", "n_words")),
        "duplicates": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "capitals": F.sqrt(per("n_capitals", "word_chars")),
    }


def chi2_cdf(x: float, d: int) -> float:
    """For an even number of degrees."""
    term, total = 1.0, 1.0
    for i in range(1, d // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return high


def grid_quantile(df: DataFrame, keys: list[str], bin_of: Column, q: float, name: str) -> DataFrame:
    """keys, name: the smallest bin that at least a share q of a group's rows doesn't exceed. Few bins make a group."""
    counts = df.groupBy(*keys, bin_of.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    lines = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("line"), F.sum("n").alias("every"))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("at"))
    step = lambda a, x: F.struct((a["upto"] + x["n"]).alias("upto"), F.coalesce(a["at"], F.when(a["upto"] + x["n"] >= F.col("every") * q, x["bin"])).alias("at"))
    return lines.select(*keys, F.aggregate("line", start, step, lambda a: a["at"]).alias(name))


def value_bin(x: Column) -> Column:
    return F.round(x * GRID)


def distance_bin(d2: Column) -> Column:
    """Of a squared distance, on a grid of logarithms; all beyond 1e12 and below 1e-6 are one bin each."""
    return F.round(F.log(F.greatest(F.least(d2, F.lit(1e12)), F.lit(1e-6))) * GRID)


D = len(COMPONENTS)
CELLS = [(i, j) for i in range(D) for j in range(i + 1)]
Z = [f"z{i}" for i in range(D)]


def covariance_scale(share: float) -> float:
    """What the covariance of the nearest share of a normal law is multiplied by to give that of the whole."""
    return share / chi2_cdf(chi2_quantile(share, D), D + 2)


def inverted(matrix: Column) -> Column:
    """A positive definite matrix (D * D numbers in an array) -> a struct of its inverse and logdet, by sweeping every pivot."""
    places = F.sequence(F.lit(0), F.lit(D * D - 1))

    def sweep(acc: Column, k: Column) -> Column:
        at = lambda i, j: F.get(acc["a"], i * D + j)
        pivot = at(k, k)

        def cell(x: Column) -> Column:
            i, j = F.floor(x / D).cast("int"), x % D
            return F.when((i == k) & (j == k), -1 / pivot).when((i == k) | (j == k), at(i, j) / pivot).otherwise(at(i, j) - at(i, k) * at(k, j) / pivot)

        return F.struct(F.transform(places, cell).alias("a"), (acc["logdet"] + F.log(pivot)).alias("logdet"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(D - 1)), F.struct(matrix.alias("a"), F.lit(0.0).alias("logdet")), sweep)
    return F.element_at(F.transform(F.array(done), lambda x: F.struct(F.transform(x["a"], lambda v: -v).alias("p"), x["logdet"].alias("logdet"))), 1)


def moments(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, m (means) and c (covariances, a whole matrix in an array)."""
    cell = {(i, j): F.covar_pop(values[i], values[j]) for i, j in CELLS}
    found = df.groupBy(*keys).agg(F.array(*[F.avg(v) for v in values]).alias("m"), F.array(*cell.values()).alias("_c"))
    at = lambda i, j: F.col("_c")[CELLS.index((max(i, j), min(i, j)))]
    return found.select(*keys, "m", F.array(*[at(i, j) for i in range(D) for j in range(D)]).alias("c"))


def regularised(fit: DataFrame, groups: DataFrame, scale: float) -> DataFrame:
    """fit: grp, start, m, c (means and covariances of what was kept) -> grp, start, m, p (the inverse), logdet.

    groups: grp, share and ridge (what the diagonal covariance of all documents adds)."""
    mixed = F.transform("c", lambda v, x: v * scale * (1 - F.col("share")) + F.when(x % (D + 1) == 0, F.get("ridge", F.floor(x / (D + 1)).cast("int"))).otherwise(0.0))
    done = fit.join(groups.select("grp", "share", "ridge"), "grp").withColumn("f", inverted(mixed))
    return done.select("grp", "start", "m", "f.p", "f.logdet")


def distance(values: list[Column]) -> Column:
    """The squared Mahalanobis distance of the values under the fit (m, p) that stands in the row; null without one."""
    total = None
    for i, j in CELLS:
        term = (values[i] - F.col("m")[i]) * (values[j] - F.col("m")[j]) * F.col("p")[i * D + j] * (1.0 if i == j else 2.0)
        total = term if total is None else total + term
    return total


def middles(df: DataFrame) -> DataFrame:
    """grp, a (medians) and s (median deviations as those of a normal law, FLOOR at least), arrays over components."""
    long = df.select("grp", F.posexplode(F.array(*COMPONENTS)).alias("j", "x"))
    middle = grid_quantile(long, ["grp", "j"], value_bin(F.col("x")), 0.5, "middle").withColumn("middle", F.col("middle") / GRID)
    off = long.join(middle, ["grp", "j"])
    wide = grid_quantile(off, ["grp", "j"], value_bin(F.abs(F.col("x") - F.col("middle"))), 0.5, "wide").withColumn("wide", F.greatest(F.col("wide") / GRID * 1.4826, F.lit(FLOOR)))
    lines = middle.join(wide, ["grp", "j"]).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("j", "middle", "wide"))).alias("l"))
    return lines.select("grp", F.col("l.middle").alias("a"), F.col("l.wide").alias("s"))


def standardised() -> list[Column]:
    """The components by the medians a and deviations s of the row's group."""
    return [(F.col(c) - F.col("a")[i]) / F.col("s")[i] for i, c in enumerate(COMPONENTS)]


def starts(z: DataFrame, groups: DataFrame) -> DataFrame:
    """The first fits of each group, in standardised components: no correlation, and three that outliers hardly change."""
    size = F.aggregate(F.array(*Z), F.lit(0.0), lambda acc, x: acc + x * x)
    sized = z.withColumn("size", size)
    half = grid_quantile(sized, ["grp"], distance_bin(F.col("size")), 0.5, "half")
    near = distance_bin(F.col("size")) <= F.col("half")
    ways = [F.tanh, lambda x: x / F.greatest(F.sqrt("size"), F.lit(1e-3)), lambda x: F.when(near, x)]
    tried = F.inline(F.array(*[F.struct(F.lit(i + 1).alias("start"), *[way(F.col(c)).cast("double").alias(c) for c in Z]) for i, way in enumerate(ways)]))
    found = moments(sized.join(half, "grp").select("grp", tried), ["grp", "start"], Z)
    side = lambda x: F.get("c", x * (D + 1))
    shape = F.transform("c", lambda v, x: F.when(x % (D + 1) == 0, 1.0).otherwise(v / F.sqrt(F.greatest(side(F.floor(x / D).cast("int")) * side(x % D), F.lit(1e-12)))))
    plain = groups.select("grp", F.lit(0).alias("start"), F.array(*[F.lit(1.0 if i == j else 0.0) for i in range(D) for j in range(D)]).alias("c"))
    first = found.select("grp", "start", shape.alias("c")).unionByName(plain).withColumn("m", F.array(*[F.lit(0.0)] * D))
    return regularised(first, groups, 1.0)


def minimum_determinant(df: DataFrame) -> DataFrame:
    """df: grp and COMPONENTS -> grp, a, s, m, p: the reweighted estimate of each group, for components standardised by a, s."""
    points = Table(df.select("grp", *COMPONENTS), "quality-points")
    every = middles(points.df.withColumn("grp", F.lit(""))).select(F.col("s").alias("w"))
    sizes = points.df.groupBy("grp").agg(F.count(F.lit(1)).cast("double").alias("n"))
    share = F.lit(RIDGE) / (F.col("n") + RIDGE)
    ridge = F.zip_with("w", "s", lambda w, s: (F.col("share") * w * w + FLOOR**2) / (s * s))
    groups = Table(middles(points.df).join(sizes, "grp").join(F.broadcast(every)).withColumn("share", share).withColumn("ridge", ridge).coalesce(FILES), "quality-groups")
    z = Table(points.df.join(groups.df.select("grp", "a", "s"), "grp").select("grp", *[x.alias(c) for c, x in zip(Z, standardised(), strict=True)]), "quality-z")
    points.drop()
    values = [F.col(c) for c in Z]
    fit = Table(starts(z.df, groups.df).withColumn("moves", F.lit(True)).coalesce(FILES), "quality-fit")
    for step in range(STEPS):
        old = fit.df.where("moves").select("grp", "start", "m", "p", "logdet")
        far = z.df.join(old, "grp").select("grp", "start", *Z, distance_bin(distance(values)).alias("bin"))
        edge = grid_quantile(far, ["grp", "start"], F.col("bin"), KEPT, "edge")
        near = far.join(edge, ["grp", "start"]).where(F.col("bin") <= F.col("edge"))
        new = regularised(moments(near, ["grp", "start"], Z), groups.df, covariance_scale(KEPT))
        both = new.join(old.select("grp", "start", F.struct("m", "p", "logdet").alias("old")), ["grp", "start"])
        # starts are no fits of a share, so the first step's is always taken
        fell = F.lit(float("inf")) if step == 0 else F.col("old.logdet") - F.col("logdet")
        least = F.when(fell > 0, F.struct("m", "p", "logdet")).otherwise(F.col("old"))
        moved = both.select("grp", "start", least.alias("f"), (fell > TOLERANCE).alias("moves")).select("grp", "start", "f.*", "moves")
        better = Table(fit.df.where(~F.col("moves")).unionByName(moved).coalesce(FILES), "quality-fit")
        fit.drop()
        fit = better
        if fit.df.where("moves").isEmpty():
            break
    raw = fit.df.groupBy("grp").agg(F.min_by(F.struct("m", "p"), F.struct("logdet", "start")).alias("f")).select("grp", "f.*")
    inside = z.df.join(raw, "grp").where(distance(values) <= chi2_quantile(WITHIN, D)).select("grp", F.lit(0).alias("start"), *Z)
    done = regularised(moments(inside, ["grp", "start"], Z), groups.df, covariance_scale(WITHIN)).select("grp", "m", "p")
    out = Table(done.join(groups.df.select("grp", "a", "s"), "grp").coalesce(FILES), "quality-fit")
    for table in (fit, groups, z):
        table.drop()
    return out.df


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` with the statistics, base_failed, kept and d2 (null where only base rules judge)."""
    keep = keep or ["doc_id"]
    extra = [F.col("lang").alias("_lang"), F.col("source").alias("_source")]
    stats = statistics(docs.select(*keep, "text", *extra), [*keep, "_lang", "_source"]).withColumn("base_failed", base_failed())
    table = Table(stats.select("*", F.to_json(F.struct("_lang", "_source")).alias("grp")), "quality-stats")
    df = table.df.withColumns(vectors())
    fit = minimum_determinant(df.where(~F.col("base_failed")).select("grp", *COMPONENTS))
    judged = df.join(fit, "grp", "left").withColumn("d2", distance(standardised()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(CUTOFF, D), F.lit(True))
    return judged.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "d2")
