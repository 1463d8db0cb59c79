"""URL filter by a ratio of character language models.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, are counted from the URLs that rules decide.
A model interpolates orders 0 to ORDER by Witten-Bell weights: in a context seen n times with t different characters,
P(c) = (count(c) + (1 + t) P'(c)) / (n + 1 + t), where P' is the next lower order's and 1/ALPHABET below order 0. So each
model gives every character a probability in every context and sums to one over the alphabet.

The log-likelihood ratio of a character is a sum over orders of what an order adds to the next lower one's: for a known gram
its own ratio less that of its suffix; for an unknown one in a known context the ratio of what both models leave to the lower
order; in an unknown context nothing. A context is the gram that ends one character before, so both parts are kept with
grams, and a URL's score is one sum over the grams that it holds, divided by its number of characters. The threshold is
where both kinds of error are equal on rule-decided URLs that weren't counted.

Only DataFrame functions. The table holds every gram of the counted URLs and is joined by shuffle; only grams of which each
takes 1 of HEAVY places or more, at most HEAVY of an order, are broadcast, so that they don't gather in one task. Equal URLs
are scored once. Windows are by context, so they hold at most one row for each character of the alphabet.

Models are fitted to and score the whole URL, its host lower-cased; only rules are limited to host and path. A URL without
`://` has an empty host and path, fits no rule and is scored as it is; a null one is scored as empty. Repeated rows repeat, other columns
are left out, an empty table gives no rows; with no rule-decided URLs every score and the threshold are 0: allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexibond.llm.shared import Table

ORDER = 4
ALPHABET = 256
HEAVY = 2000
HELD_OUT = 5  # one URL of so many calibrates
BINS = 100  # bins of the calibration in a unit of score; scores are clamped to +-20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _tail(url: Column) -> Column:
    """What follows the first `://`; empty if there is none."""
    return F.when(url.contains("://"), F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)).otherwise("")


def host_of(url: Column) -> Column:
    tail = _tail(url)
    return F.coalesce(F.translate(F.regexp_extract(tail, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    tail = _tail(url)
    return F.coalesce(F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def whole_of(url: Column) -> Column:
    """The whole URL with its host lower-cased, a null one as empty."""
    tail = _tail(url)
    whole = F.concat(F.substring_index(url, "://", 1), F.lit("://"), host_of(url), F.regexp_extract(tail, r"(?s)^[^/?#]*(.*)$", 1))
    return F.coalesce(F.when(url.contains("://"), whole).otherwise(url), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """rules: (allow or block, host, path). The longest that fits: its text host + path and its verdict, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def grams(urls: DataFrame, keep: list[str]) -> DataFrame:
    """Every character of `s` with its contexts of 0 to ORDER characters: k, gram (context and character)."""
    chars = urls.select(*keep, F.concat(F.array_repeat(F.lit("\x02"), ORDER), F.split(F.concat("s", F.lit("\x03")), "")).alias("chars"))
    # split by "" may leave an empty last part, which isn't a character
    chars = chars.select(*keep, F.filter("chars", lambda c: c != "").alias("chars"))
    spots = chars.select(*keep, "chars", F.explode(F.sequence(F.lit(ORDER + 1), F.size("chars"))).alias("i"))
    picks = F.array(*[F.struct(F.lit(k).alias("k"), F.array_join(F.slice("chars", F.col("i") - k, k + 1), "").alias("gram")) for k in range(ORDER + 1)])
    return spots.select(*keep, F.inline(picks))


def fit(labelled: DataFrame) -> DataFrame:
    """labelled: s, good (boolean) -> k, gram, delta, seen: the table of all grams, and a row of k = -1 with two numbers:
    delta is what every character of a URL adds, seen what a URL adds once (by its empty beginning)."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    counted = Table(grams(labelled, ["good"]).groupBy("k", "gram").agg(one(F.col("good")).alias("a"), one(~F.col("good")).alias("r")), "url-counts")
    whole = Window.partitionBy("k", "context")
    table = counted.df.withColumn("context", F.substr("gram", F.lit(1), F.col("k")))
    for c in ("a", "r"):
        table = table.withColumn(f"n_{c}", F.sum(c).over(whole)).withColumn(f"t_{c}", F.sum(F.when(F.col(c) > 0, 1.0).otherwise(0.0)).over(whole))
    left = lambda c: (1 + F.col(f"t_{c}")) / (F.col(f"n_{c}") + 1 + F.col(f"t_{c}"))
    table = table.withColumn("leaves", F.log(left("a") / left("r")))
    totals = Table(table.select("k", "gram", "context", "leaves", (F.col("a") + F.col("r")).alias("seen"), *[x for c in ("a", "r") for x in (c, f"n_{c}", f"t_{c}")]), "url-totals")
    counted.drop()
    smooth = lambda c, low: (F.col(c) + (1 + F.col(f"t_{c}")) * low) / (F.col(f"n_{c}") + 1 + F.col(f"t_{c}"))
    done, orders = None, []
    for k in range(ORDER + 1):
        own = totals.df.where(F.col("k") == k)
        if k == 0:
            own = own.withColumns({"la": F.lit(1 / ALPHABET), "lr": F.lit(1 / ALPHABET)})
        else:
            low = orders[-1].df.select(F.col("gram").alias("suffix"), F.col("pa").alias("la"), F.col("pr").alias("lr"))
            own = own.withColumn("suffix", F.expr("substring(gram, 2)")).join(low, "suffix")
        own = own.withColumns({"pa": smooth("a", F.col("la")), "pr": smooth("r", F.col("lr"))})
        adds = F.log(F.col("pa") / F.col("pr")) - F.log(F.col("la") / F.col("lr")) - F.col("leaves")
        orders.append(Table(own.select("k", "gram", "pa", "pr", adds.alias("adds"), "seen"), "url-order"))
    for k, order in enumerate(orders):
        # the grams of this order are the contexts of the next
        after = totals.df.where(F.col("k") == k + 1).groupBy(F.col("context").alias("gram")).agg(F.min("leaves").alias("leaves"))
        rows = order.df.join(after, "gram", "left").select("k", "gram", (F.col("adds") + F.coalesce("leaves", F.lit(0.0))).alias("delta"), "seen")
        done = rows if done is None else done.unionByName(rows)
    empty = F.lit(None).cast("string")
    begin = F.lit(False)
    for k in range(1, ORDER + 1):
        begin = begin | ((F.col("k") == k) & (F.col("context") == "\x02" * k))
    contexts = totals.df.where(begin | (F.col("k") == 0)).groupBy("k").agg(F.min("leaves").alias("leaves"))
    fixed = contexts.agg(F.sum(F.when(F.col("k") == 0, F.col("leaves"))).alias("delta"), F.sum(F.when(F.col("k") > 0, F.col("leaves"))).alias("seen"))
    fixed = fixed.select(F.lit(-1).alias("k"), empty.alias("gram"), F.coalesce("delta", F.lit(0.0)).alias("delta"), F.coalesce("seen", F.lit(0.0)).alias("seen"))
    model = Table(done.unionByName(fixed), "url-model")
    for table in (totals, *orders):
        table.drop()
    return model.df


def score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """Distinct s with its mean log-likelihood ratio a character."""
    distinct = urls.select("s").distinct()
    # 128 bits stand for a URL where its characters are dealt
    keyed = distinct.withColumns({"u": F.xxhash64("s"), "v": F.xxhash64(F.lit("v"), "s")})
    places = model.where(F.col("k") == 0).agg(F.sum("seen")).scalar()
    often = F.col("seen") * HEAVY >= places
    heavy, light = (model.where((F.col("k") >= 0) & c).select("k", "gram", "delta") for c in (often, ~often))
    spots = grams(keyed, ["u", "v"])
    dealt = spots.join(F.broadcast(heavy.select("k", "gram")), ["k", "gram"], "left_anti")
    sums = [found.groupBy("u", "v").agg(F.sum("delta").alias("part")) for found in (spots.join(F.broadcast(heavy), ["k", "gram"]), dealt.join(light, ["k", "gram"]))]
    total = sums[0].unionByName(sums[1]).groupBy("u", "v").agg(F.sum("part").alias("total"))
    each, once = (model.where(F.col("k") == -1).agg(F.max(c)).scalar() for c in ("delta", "seen"))
    size = F.length("s") + 1
    return keyed.join(total, ["u", "v"], "left").select("s", ((F.coalesce("total", F.lit(0.0)) + each * size + once) / size).alias("score"))


def calibrate(scored: DataFrame) -> DataFrame:
    """good, score -> one row, threshold: where the shares of lost good and of passed bad URLs are nearest."""
    at = F.round(F.greatest(F.least("score", F.lit(20.0)), F.lit(-20.0)) * BINS).cast("int")
    bins = scored.groupBy(at.alias("bin")).agg(F.sum(F.col("good").cast("int")).alias("g"), F.sum((~F.col("good")).cast("int")).alias("b"))
    upto, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lost = F.coalesce(F.sum("g").over(upto), F.lit(0)) / F.greatest(F.sum("g").over(every), F.lit(1))
    passed = 1 - F.coalesce(F.sum("b").over(upto), F.lit(0)) / F.greatest(F.sum("b").over(every), F.lit(1))
    gaps = bins.select("bin", F.abs(lost - passed).alias("gap"))
    return gaps.agg(F.min(F.struct("gap", F.abs("bin").alias("size"), "bin")).alias("m")).select(((F.col("m.bin") - 0.5) / BINS).alias("threshold"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_column: str = "page_id") -> DataFrame:
    """id, host, path, rule, verdict, score (null where a rule decides) and threshold."""
    parsed = pages.select(id_column, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), whole_of(F.col("url")).alias("s"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "said": said})
    seeds = parsed.where(F.col("said").isNotNull()).select("s", (F.col("said") == "allow").alias("good")).distinct()
    out = F.pmod(F.xxhash64("s"), F.lit(HELD_OUT)) == 0
    model = fit(seeds.where(~out))
    held = seeds.where(out)
    threshold = Table(calibrate(held.join(score(held, model), "s", "left").select("good", F.coalesce("score", F.lit(0.0)).alias("score"))), "url-threshold").df
    open_ones = parsed.where(F.col("rule").isNull())
    joined = parsed.join(score(open_ones, model), "s", "left")
    mine = F.when(F.col("rule").isNull(), F.coalesce("score", F.lit(0.0)))
    limit = F.coalesce(threshold.scalar(), F.lit(0.0))
    return joined.select(id_column, "host", "path", "rule", F.coalesce("said", F.when(mine >= limit, "allow").otherwise("block")).alias("verdict"), mine.alias("score"), limit.alias("threshold"))
