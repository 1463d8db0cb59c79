from math import log

import pytest

from lexibond.operators import ngrams as G
from lexibond.operators import scoring as S
from lexibond.operators import vocabulary as V
from lexibond.plans.mining import score_tokens

# A sample, and below a table of likelihoods, whose results are known in closed form.
LINE = [1, 1, 1, 0, 1, 0, 2, 0, 2, 1]


def table(spark, samples):
    return spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "sample_id long, tokens array<int>")


def as_dict(df, value="count"):
    return {tuple(r["ngram"]): r[value] for r in df.collect()}


def brute_counts(samples, n):
    out = {}
    for s in samples:
        for i in range(len(s) - n + 1):
            out[tuple(s[i : i + n])] = out.get(tuple(s[i : i + n]), 0) + 1
    return out


def test_counts_of_one_sample(spark):
    got = as_dict(G.count_ngrams(table(spark, [LINE]), [1, 2, 3]))
    want = {}
    for n in (1, 2, 3):
        want |= brute_counts([LINE], n)
    assert got == want
    assert got[(1,)] == 5 and got[(1, 0)] == 2 and got[(0, 2, 1)] == 1


def test_nothing_crosses_samples_and_short_samples_yield_nothing(spark):
    samples = [[1, 1, 1, 0, 1], [2, 2, 2], [], [7]]
    got = as_dict(G.count_ngrams(table(spark, samples), [1, 2, 3, 4, 5]))
    want = {}
    for n in range(1, 6):
        want |= brute_counts(samples, n)
    assert got == want


def test_totals(spark):
    got = {r["n"]: r["total"] for r in G.totals(table(spark, [[1, 2, 3, 4], [1], [1, 2, 3, 4, 5, 6]]), 3).collect()}
    assert got == {1: 11, 2: 8, 3: 6}
    empty = {r["n"]: r["total"] for r in G.totals(table(spark, []), 2).collect()}
    assert empty == {1: 0, 2: 0}


@pytest.mark.parametrize("held", [30, 4_000_000])
def test_id_counts_equal_brute_force(spark, monkeypatch, held):
    import random

    monkeypatch.setattr(G, "HELD_TOKENS", held)
    r = random.Random(held)
    samples = [[min(r.randrange(9), r.randrange(9)) for _ in range(r.choice([0, 1, 2, 3, 9, 40]))] for _ in range(30)]
    want = {}
    for n in range(1, 6):
        want |= brute_counts(samples, n)
    for least in (1, 2, 4):
        for pairs in (4_000_000, 0):
            monkeypatch.setattr(G, "PAIRS", pairs)
            got = as_dict(G.count_id_ngrams(table(spark, samples).repartition(3), 5, least))
            assert got == {g: c for g, c in want.items() if c >= least}
    assert as_dict(G.count_id_ngrams(table(spark, []), 3, 2)) == {} and as_dict(G.count_id_ngrams(table(spark, [[7], []]), 3, 2)) == {}


def test_pairs_beyond_the_limit_still_filter(spark, monkeypatch):
    """Rare windows aren't shuffled however many pairs there are, and what the bitmap lets through in vain is pruned."""
    import random

    r = random.Random(8)
    samples = [[min(r.randrange(40), r.randrange(40)) for _ in range(60)] for _ in range(40)]
    want = {g: c for n in (3, 4, 5) for g, c in brute_counts(samples, n).items() if c >= 3}
    monkeypatch.setattr(G, "PAIRS", 64)
    monkeypatch.setattr(G, "_count_parts", None)  # the way that counts every window of frequent tokens
    assert as_dict(G.count_from_pairs(table(spark, samples).repartition(3), [3, 4, 5], 3)) == want
    keys = G.count_pairs(table(spark, samples), None, 3)
    bitmap = G.pair_bitmap(keys)
    known = keys.toPandas()["key"].to_numpy()
    assert len(bitmap) == 4096 and G._maybe(bitmap, known).all()
    assert G._maybe(bitmap, known + (1 << 40)).mean() < 0.2


def test_declared_tables_are_unique(spark):
    rows = [(2, [1, 2], 5), (2, [2, 1], 4), (1, [1], 9)]
    df = spark.createDataFrame(rows, "n int, ngram array<int>, count long")
    assert [f.dataType for f in G.declared(df, 2).schema] == [f.dataType for f in G.wide_schema(2)]
    with pytest.raises(ValueError):
        G.declared(df.unionByName(df.limit(1)), 2)


def test_batches_prune_before_summing(spark):
    t = table(spark, [[1, 2], [1, 2], [1, 2], [3, 4]])
    assert as_dict(G.count_in_batches(t, [2], 2, 2)) == {(1, 2): 2}
    assert as_dict(G.count_in_batches(t, [2], 2, 1)) == {(1, 2): 3, (3, 4): 1}
    assert as_dict(G.count_in_batches(t, [2], 4, 2)) == {(1, 2): 3}


def test_merge(spark):
    make = lambda rows: spark.createDataFrame([(2, g, c) for g, c in rows], "n int, ngram array<int>, count long")
    got = as_dict(G.merge_counts(make([([1, 2], 6), ([2, 1], 5)]), make([([1, 1], 5), ([2, 1], 2)])))
    assert got == {(1, 1): 5, (1, 2): 6, (2, 1): 7}


def test_wide_columns(spark):
    df = spark.createDataFrame([(2, [5, 6], 9), (1, [5], 3)], "n int, ngram array<int>, count long")
    assert [tuple(r) for r in G.wide(df, 2).collect()] == [(5, 6, 9)]
    assert G.wide(df, 2).columns == ["token_0", "token_1", "count"]


def test_log_likelihood(spark):
    counts = spark.createDataFrame([(1, [1], 5), (1, [2], 4), (2, [1, 1], 3)], "n int, ngram array<int>, count long")
    totals = spark.createDataFrame([(1, 9), (2, 8)], "n int, total long")
    got = as_dict(S.with_log_likelihood(counts, totals), "log_likelihood")
    assert got[(1,)] == pytest.approx(log(5 / 9)) and got[(1, 1)] == pytest.approx(log(3 / 8))


def scored(spark, rows):
    return spark.createDataFrame([(len(g), g, ll) for g, ll in rows], "n int, ngram array<int>, log_likelihood double")


def test_max_segmentation(spark):
    df = scored(spark, [([0], -0.1), ([1], -0.2), ([0, 0], -0.2), ([0, 1], -0.3), ([1, 0], -0.15), ([0, 0, 0], -0.3), ([0, 1, 0], -0.4)])
    got = as_dict(S.max_segmentation(df, 3), "max_segmentation_log_likelihood_sum")
    want = {(0, 0): -0.2, (0, 1): -0.3, (1, 0): -0.3, (0, 0, 0): -0.3, (0, 1, 0): -0.25}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_missing_parts_surface_as_null(spark):
    got = as_dict(S.max_segmentation(scored(spark, [([0], -0.1), ([0, 9], -0.3)]), 2), "max_segmentation_log_likelihood_sum")
    assert got == {(0, 9): None}


def test_segmentations():
    assert len(S.segmentations(4)) == 7 and len(S.segmentations(5)) == 15
    assert [(0, 1), (1, 3)] in S.segmentations(4)
    with pytest.raises(ValueError):
        S.segmentations(1)


def test_recursion_equals_brute_force(spark):
    t = table(spark, [[1, 1, 1, 2, 3, 1, 0, 0, 1], [1, 2, 1, 3, 3, 0], [1, 2, 2, 3, 1, 0, 0, 1]])
    ll = S.with_log_likelihood(G.count_ngrams(t, [1, 2, 3, 4, 5]), G.totals(t, 5)).cache()
    fast = as_dict(S.max_segmentation(ll, 5), "max_segmentation_log_likelihood_sum")
    splits = as_dict(S.max_segmentation_by_splits(ll, 4), "max_segmentation_log_likelihood_sum")
    assert splits and all(fast[k] == pytest.approx(v) for k, v in splits.items())
    for n in range(2, 6):
        slow = as_dict(S.max_segmentation_by_force(ll, n), "max_segmentation_log_likelihood_sum")
        assert slow
        for k, v in slow.items():
            assert fast[k] == pytest.approx(v)


def test_pmi_closed_form(spark):
    got = as_dict(score_tokens(table(spark, [LINE]), 3), "pmi_score")
    assert got[(0, 1)] == pytest.approx(log((1 / 9) ** 2 / (3 / 10 * 5 / 10)))
    assert got[(1, 1)] == pytest.approx(log((2 / 9) ** 2 / (5 / 10 * 5 / 10)))
    assert got[(1, 1, 1)] == pytest.approx(min(log((1 / 8) ** 2 / (5 / 10) ** 3), log((1 / 8) ** 2 / (2 / 9 * 5 / 10))))


def test_counts_do_not_depend_on_partitions(spark):
    t = table(spark, [LINE, LINE[::-1], [1, 2] * 20])
    assert as_dict(G.count_ngrams(t.repartition(1), [2])) == as_dict(G.count_ngrams(t.repartition(7), [2]))


def test_every_part_of_a_survivor_survives(spark):
    t = table(spark, [[1, 2, 3, 1, 2, 3, 9], [4, 1, 2, 3]])
    grams = set(as_dict(G.count_ngrams(t, [1, 2, 3], 2)))
    assert (1, 2, 3) in grams
    for g in grams:
        for i in range(len(g)):
            for j in range(i + 1, len(g) + 1):
                assert g[i:j] in grams


def test_top_of_size(spark):
    rows = [(2, [i, i], s) for i, s in enumerate([0.0, 0.1, 0.02, 0.3, 0.04, 0.5, 0.06, 0.7, 0.08, 0.9])]
    df = spark.createDataFrame(rows, "n int, ngram array<int>, pmi_score double")
    got = [r["ngram"][0] for r in V.top_of_size(df, 2, 5).orderBy("rank").collect()]
    assert got == [9, 7, 5, 3, 1]


def test_ties_and_shortfall(spark):
    df = spark.createDataFrame([(2, [2, 1], 1.0), (2, [1, 9], 1.0), (3, [1, 1, 1], 0.5), (2, [0, 0], None)], "n int, ngram array<int>, pmi_score double")
    got = [(r["n"], r["rank"], r["ngram"]) for r in V.select_vocabulary(df, {2: 5, 3: 1}).orderBy("n", "rank").collect()]
    assert got == [(2, 1, [1, 9]), (2, 2, [2, 1]), (2, 3, [0, 0]), (3, 1, [1, 1, 1])]


def test_compare_counts_repeats(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), ("z",)], "v string")
    b = spark.createDataFrame([("x",), ("q",)], "v string")
    r = V.compare_vocabularies(a, b).first()
    assert (r["common"], r["first_share"], r["second_share"]) == (1, 0.25, 0.5)
    none = V.compare_vocabularies(a, b.limit(0)).first()
    assert none["second_share"] is None and none["first_share"] == 0.0


def test_wide_schema():
    assert [f.name for f in G.wide_schema(2, ("pmi_score",))] == ["token_0", "token_1", "count", "pmi_score"]
    with pytest.raises(ValueError):
        G.wide_schema(2, ("x",))
