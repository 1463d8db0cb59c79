"""Words without a cap, coded corpora, batches counted in one task, and how small tables are dealt."""

import glob
import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexibond.functions import text as T
from lexibond.operators import ngrams as G
from lexibond.plans import queries as Q
from lexibond.tables import Table
from tests.test_ngrams import as_dict, brute_counts


def corpus(spark, seed=3, texts=60):
    r = random.Random(seed)
    rows = [(i, [f"w{min(r.randrange(60), r.randrange(60))}" for _ in range(r.choice([0, 1, 2, 9, 40]))]) for i in range(texts)]
    return rows, spark.createDataFrame(rows, "sample_id long, tokens array<string>")


@pytest.mark.parametrize("chars", [64_000_000, 0])
def test_coded_ids_have_no_unknown_word(spark, monkeypatch, chars):
    rows, table = corpus(spark)
    monkeypatch.setattr(T, "PART_TOKENS", 50)
    monkeypatch.setattr(T, "HELD_CHARS", chars)
    counts = brute_counts([s for _, s in rows], 1)
    order = sorted(counts, key=lambda g: (-counts[g], g))
    parts = Table(T.code_words(table.repartition(3)), "coded").df
    assert {(r["token"],): r["count"] for r in T.count_coded(parts).collect()} == counts
    names = T.frequent_words(T.count_coded(parts), 5)
    want = {g[0]: len(T.SPECIALS) + i for i, g in enumerate(order) if counts[g] >= 5}
    assert {r["token"]: r["token_id"] for r in names.collect()} == want
    ids = Table(T.frequent_ids(parts, names), "ids").df
    assert {r["sample_id"]: r["tokens"] for r in ids.collect()} == {i: [want.get(w, T.NO_WORD) for w in s] for i, s in rows}
    # no n-gram of rare words is counted as if they were one
    for sizes in ([2], [3], [2, 3, 4, 5]):
        grams = {g: c for n in sizes for g, c in brute_counts([s for _, s in rows], n).items() if c >= 5}
        got = as_dict(Q._named(G.count_from_pairs(ids, sizes, 5), names))
        assert got == grams


def test_every_word_has_a_rank(spark):
    words = [(f"w{i:03d}", 9 - i // 40) for i in range(200)]
    got = {r["token"]: r["token_id"] for r in T.rank_words(spark.createDataFrame(words, "token string, count long").repartition(5)).collect()}
    assert got == {w: len(T.SPECIALS) + i for i, (w, _) in enumerate(sorted(words, key=lambda x: (-x[1], x[0])))}


@pytest.mark.parametrize("held", [20, 4_000_000])
def test_dealt_batches_equal_shuffled_ones(spark, monkeypatch, held):
    _, table = corpus(spark, held, 90)
    table = table.unionByName(spark.createDataFrame([(None, ["w1", "w2", "w1", "w2"])], table.schema))
    monkeypatch.setattr(G, "HELD_TOKENS", held)
    batch = F.floor(F.col("sample_id") / 10)
    dealt = table.repartition(3, batch).sortWithinPartitions(batch)
    rows = lambda df: sorted((str(r["batch_id"]), tuple(r["ngram"]), r["count"]) for r in df.collect())
    want = rows(G.batch_counts(table, [1, 2], 10, 2))
    assert want and rows(G.batch_counts(dealt, [1, 2], 10, 2, dealt=True)) == want


def test_short_ways_of_the_normaliser_equal_the_long_one(spark):
    signs = [chr(c) for low, high in T.SIMPLE for c in range(low, high + 1)]
    df = spark.createDataFrame([(f"Ab{c} {c}x",) for c in signs], "t string")
    rows = df.select("t", T.normalise(F.col("t")).alias("a"), T._folded(F.col("t")).alias("b")).collect()
    assert [r["t"] for r in rows if r["a"] != r["b"]] == []


def test_a_file_of_one_row_group_is_dealt_in_shares(spark, monkeypatch, tmp_path):
    spark.range(3000).select(F.col("id").alias("sample_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/one")
    monkeypatch.setattr(Q, "SPREAD_BYTES", 10_000)
    assert Q.spread(spark.read.parquet(f"{tmp_path}/one")).rdd.getNumPartitions() > 8


def test_texts_cut_by_bytes_equal_their_words(spark, monkeypatch):
    """Bytes of plain and western texts, and the tokens of others, give what `words` gives, wherever texts end."""
    r = random.Random(2)
    signs = [chr(c) for low, high in T.SIMPLE for c in range(low, high + 1)]
    plain = [chr(c) for c in (9, 10, 13, *range(32, 127))]
    other = list("漢語한글ΑΒΓжЙ。、 ­​\x0b\x0c\x1f\x7f́ 😀İẞ")
    texts = [None, "", " ", "É", "é", "ÉÈ", "¿", "—", "aé", "…b", *[f"Ab{c} {c}x{c}" for c in signs]]
    texts += ["".join(r.choice(some) for _ in range(r.choice([1, 2, 5, 30]))) for some in (plain, plain + signs[:80], plain + signs, plain + signs[:80] + other) for _ in range(150)]
    texts += ["é—" * 100_000]  # the check of characters doesn't recurse
    df = spark.createDataFrame(list(enumerate(texts)), "sample_id long, text string").repartition(3)
    want = {x["sample_id"]: x["tokens"] for x in T.tokenise(df).collect()}
    for part, size in ((1_000_000, 4_000_000), (40, 25), (40, 1)):
        monkeypatch.setattr(T, "PART_TOKENS", part)
        monkeypatch.setattr(T, "CUT_BYTES", size)
        got = {}
        for p in T.code_texts(df).collect():
            codes = [p["words"][c] for c in memoryview(p["codes"]).cast("i")]
            assert p["counts"] == [codes.count(w) for w in p["words"]] or len(codes) > 100_000
            for i, n in zip(p["sample_id"], p["lengths"], strict=True):
                got[i], codes = codes[:n], codes[n:]
            assert not codes
        assert got == want


def test_texts_are_only_of_the_characters_that_a_pattern_names(spark):
    """The quick patterns let through what the ranges say, each character by itself and in a text."""
    every = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    named = lambda c, most: c in "\t\n\r" or " " <= c <= "~" or any(low <= ord(c) <= (high if low > 0xFF else min(high, most)) for low, high in T.SIMPLE)
    df = spark.createDataFrame([(c, f"ab{c}—c") for c in every], "c string, t string")
    rows = df.select("c", *[F.col(t).rlike(p).alias(f"{t}_{n}") for t in ("c", "t") for n, p in (("w", T._WESTERN), ("s", T._SIMPLE))]).collect()
    assert [r["c"] for r in rows if {r["c_w"], r["t_w"]} != {named(r["c"], 0xFF)} or {r["c_s"], r["t_s"]} != {named(r["c"], 0x24F)}] == []


@pytest.mark.parametrize("shares", [1, 3, 70_000])
def test_counts_are_dealt_and_added_up_in_arrays(spark, monkeypatch, shares):
    """Equal n-grams of different tasks and shares come together, whatever the number of shares; nothing is dealt for no n-gram."""
    monkeypatch.setattr(G, "HELD_TOKENS", 25)
    monkeypatch.setattr(G, "_shares", lambda ids: min(shares, 4))
    r = random.Random(shares)
    samples = [[min(r.randrange(7), r.randrange(7)) for _ in range(r.choice([0, 1, 2, 3, 30]))] for _ in range(40)]
    ids = spark.createDataFrame(list(enumerate(samples)), "sample_id long, tokens array<int>").repartition(3)
    want = {g: c for n in (2, 3, 4, 5) for g, c in brute_counts(samples, n).items() if c >= 3}
    assert want and as_dict(G.count_from_pairs(ids, [2, 3, 4, 5], 3)) == want
    some = G.np.arange(1000, dtype=G.np.int64)
    rows = G._dealt(3, some << 32, None, some % 7, some + 1, shares)
    assert sum(len(x) for x in rows.column("key").to_pylist()) == 8000 and set(rows.column("more").to_pylist()) == {b""}
    pairs = {k: c for keys, counts in zip(rows.column("key").to_pylist(), rows.column("count").to_pylist(), strict=True) for k, c in zip(memoryview(keys).cast("q"), memoryview(counts).cast("q"), strict=True)}
    assert pairs == {int(k) << 32: int(k) + 1 for k in some}
    assert G._dealt(2, some[:0], None, None, some[:0], shares).num_rows == 0


@pytest.mark.parametrize(("chars", "held"), [(64_000_000, 25), (0, 1_000_000)])
def test_packed_ids_count_as_arrays_do(spark, monkeypatch, chars, held):
    """Rows of many samples hold what frequent_ids has sample by sample: counts, totals and where samples end."""
    rows, table = corpus(spark, 5)
    monkeypatch.setattr(T, "PART_TOKENS", 60)
    monkeypatch.setattr(T, "HELD_CHARS", chars)
    monkeypatch.setattr(G, "HELD_TOKENS", held)
    parts = Table(T.code_words(table.unionByName(spark.createDataFrame([(None, None)], table.schema)).repartition(3)), "coded").df
    names = T.frequent_words(T.count_coded(parts), 5)
    flat, packed = Table(T.frequent_ids(parts, names), "ids").df, Table(T.packed_ids(parts, names), "ids", large=True).df
    cut = []
    for r in packed.collect():
        tokens = list(memoryview(r["tokens"]).cast("i"))
        for n in r["lengths"]:
            cut.append(tokens[:n])
            tokens = tokens[n:]
        assert not tokens
    assert len(cut) == len(rows) + 1 and sorted(cut) == sorted(r["tokens"] for r in flat.collect())
    for sizes, least in (([2], 1), ([2, 3, 4, 5], 2), ([3, 6], 2)):
        got, want = (as_dict(G.count_from_pairs(ids, sizes, least)) for ids in (packed, flat))
        assert want and got == want
    wanted = [(n, sum(max(0, len(s) - n + 1) for _, s in rows)) for n in range(1, 6)]
    assert sorted(tuple(r) for r in G.totals(packed, 5).collect()) == wanted == sorted(tuple(r) for r in G.totals(flat, 5).collect())
    assert G.totals_wide(packed.limit(0), 2).collect() == G.totals_wide(flat.limit(0), 2).collect()


def test_queries_read_ids_in_rows_of_many_samples(spark, monkeypatch, tmp_path):
    """log_likelihood_3: as many rows of ids as parts, not as texts, and the likelihoods of brute force."""
    r = random.Random(6)
    texts = [" ".join(f"w{min(r.randrange(9), r.randrange(9))}" for _ in range(r.choice([0, 1, 2, 9, 40]))) for _ in range(200)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids, _ = Q._frequent(Q.load_corpus(spark, "documents", str(tmp_path)))
    assert ids.count() <= spark.sparkContext.defaultParallelism and ids.select(F.sum(F.size("lengths"))).first()[0] == 200
    samples = [t.split() for t in texts]
    total = sum(max(0, len(s) - 2) for s in samples)
    want = {g: (c, round(math.log(c / total), 6)) for g, c in brute_counts(samples, 3).items() if c >= Q.MIN_COUNT}
    got = {tuple(x)[:3]: tuple(x)[3:] for x in Q.log_likelihood(spark, str(tmp_path), 3).collect()}
    assert want and got.keys() == want.keys()
    assert all(got[g][0] == c and got[g][1] == pytest.approx(ll, abs=2e-6) for g, (c, ll) in want.items())


def test_large_rows_are_written_in_groups_of_a_few(spark):
    tokens = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1 << 16)), lambda i: F.sha2(F.concat("id", i).cast("string"), 256)), "")
    rows = spark.range(12, numPartitions=1).select("id", tokens.cast("binary").alias("tokens"))
    table = Table(rows, "ids", large=True)
    files = glob.glob(f"{table.path.removeprefix('file:')}/*.parquet")
    assert [pq.ParquetFile(f).metadata.num_row_groups > 1 for f in files] == [True]
    assert table.df.select(F.sum(F.length("tokens"))).first()[0] == 12 << 22
