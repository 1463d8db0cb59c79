import datetime

import pytest
from pyspark.sql import functions as F

from lexibond import sources
from lexibond.__main__ import config_of, parser
from lexibond.config import MiningConfig, size_quotas
from lexibond.functions import text as T
from lexibond.functions.units import duration_text, grow_linear, grow_n_log_n, grow_step, size_text
from lexibond.operators import runlog as L
from lexibond.plans.mining import run, run_to_file
from lexibond.plans.queries import RUN_LINES
from lexibond.sources.sinks import run_logger, write_totals


@pytest.fixture(scope="module")
def corpus_root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, "the red fox, the red fox runs. Ünïque fox" if i % 2 else "a Red hen\nsleeps") for i in range(20)] + [(20, None), (21, "")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(0, 0, "user", "red fox"), (0, 1, "assistant", "the hen")], "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    return root


def test_config_checks():
    good = dict(experiment_name="x", dataset_name="documents")
    assert MiningConfig(**good).quotas == {2: 400_000, 3: 200_000, 4: 100_000, 5: 100_000}
    for bad in ({"max_ngram_size": 1}, {"percents": (50.0, 50.0)}, {"percents": (50.0, 25.0, 12.5, 12.0)}, {"min_count_threshold": 1}, {"vocab_size": 0}, {"n_samples": 0}, {"experiment_name": ""}, {"percents": (100.0, 0.0, 0.0, 0.0)}, {"min_count_batch_threshold": 10}):
        with pytest.raises(ValueError):
            MiningConfig(**(good | bad))


def test_quota_remainder_goes_to_pairs():
    assert size_quotas({2: 33, 3: 33, 4: 34}, 10) == {2: 4, 3: 3, 4: 3}


def test_command_line():
    args = ["--experiment_name", "x", "--dataset_name", "documents", "--root", "r", "--out", "o"]
    assert config_of(parser().parse_args(args)).max_ngram_size == 5
    for extra in (["--max_ngram_size", "1"], ["--vocab_size", "x"], ["--ngram_size_to_vocab_percent", "-1"]):
        with pytest.raises(SystemExit):
            parser().parse_args(args + extra)


def test_words(spark):
    df = spark.createDataFrame([("Él dijo: ¡Hola, mundo!\n$5^x",), (None,), ("  ",)], "t string")
    assert [r[0] for r in df.select(T.words(F.col("t"))).collect()] == [["el", "dijo", ":", "¡", "hola", ",", "mundo", "!", "$", "5", "^", "x"], [], []]


def test_normaliser_equals_the_library(spark):
    """On letters of many scripts, marks, control characters, white space and signs; only what every version of Unicode agrees on."""
    import random
    import unicodedata

    from tokenizers import normalizers, pre_tokenizers

    r = random.Random(5)
    ranges = [(0, 0x250), (0x250, 0x590), (0x1E00, 0x2000), (0x2000, 0x2070), (0x3000, 0x3100), (0x4E00, 0x4E80), (0xAC00, 0xD7A4), (0x900, 0x950), (0xF900, 0xFA00), (0xFF00, 0xFF60)]
    texts = []
    for low, high in ranges:
        known = [chr(c) for c in range(low, high) if unicodedata.category(chr(c)) != "Cn"]
        texts += [" ".join(r.choice(known) + r.choice(["", "a", "\u0301"]) for _ in range(60)) for _ in range(12)]
    texts += ["Ångström 漢字 한국어 Ünïque\x0bfox\u00a0x\u0085 İ ﬁ", "plain Text\twith\nlines!"]
    bert, split = normalizers.BertNormalizer(), pre_tokenizers.BertPreTokenizer()
    got = [x[0] for x in spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i").select(T.words(F.col("t"))).collect()]
    for text, tokens in zip(texts, got, strict=True):
        assert tokens == [w for w, _ in split.pre_tokenize_str(bert.normalize_str(text))], text


def test_words_beyond_the_cap_are_cut_by_ranges(spark):
    words = [(f"w{i:03d}", 9 - i // 40) for i in range(200)]
    order = sorted(words, key=lambda x: (-x[1], x[0]))
    table = spark.createDataFrame(words, "token string, count long").repartition(5)
    for room in (1, 39, 40, 41, 130, 199, 200, 300):
        got = {x["token"]: x["token_id"] for x in T.number_words(table, room + 5).collect()}
        assert got == {t: i for i, t in enumerate([*T.SPECIALS, *[w for w, _ in order[:room]]])}
    assert T.number_words(table.limit(0)).count() == 5


def test_vocabulary_and_encoding(spark):
    corpus = spark.createDataFrame([(0, "b a b"), (1, "c b"), (2, "")], "sample_id long, text string")
    vocab = {r["token"]: r["token_id"] for r in T.train_word_level(corpus, 7).collect()}
    assert vocab == {"[UNK]": 0, "[PAD]": 1, "[CLS]": 2, "[SEP]": 3, "[MASK]": 4, "b": 5, "a": 6}
    for way in (T.encode, T.encode_by_join):
        ids = {r["sample_id"]: r["input_ids"] for r in way(T.tokenise(corpus), T.train_word_level(corpus, 7)).collect()}
        assert ids == {0: [5, 6, 5], 1: [0, 5], 2: []}


def test_word_pieces(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("[UNK]\nfox\n##es\nred\n", encoding="utf-8")
    cut = T.word_piece(T.load_word_pieces(spark, str(tmp_path / "vocab.txt")))
    df = spark.createDataFrame([(["foxes", "red", "zzz"],)], "t array<string>")
    assert df.select(cut("t")).first()[0] == [1, 2, 3, 0]


def test_word_piece_run(spark, corpus_root):
    pieces = {p: i for i, p in enumerate(["[UNK]", "the", "red", "fo", "##x", "hen", ",", "runs"])}
    T.register_tokenizer(T.word_piece_spec(pieces))
    config = MiningConfig("p", "documents", "word-piece", max_ngram_size=2, min_count_threshold=2, vocab_size=50, percents=(100.0,))
    texts = {r["ngram_text"] for r in run(spark, config, corpus_root).vocabulary.collect()}
    assert {"fox", "red fo", "the red"} <= texts


def test_command_line_runs(spark, corpus_root, tmp_path):
    from lexibond.__main__ import main

    args = ["--experiment_name", "cli", "--dataset_name", "documents", "--root", corpus_root, "--out", str(tmp_path), "--max_ngram_size", "2", "--min_count_threshold", "2", "--vocab_size", "5", "--ngram_size_to_vocab_percent", "100"]
    main([*args, "--clean_up"])
    assert sources.read_vocabulary(spark, f"{tmp_path}/cli/vocabulary").count() == 5
    assert not (tmp_path / "cli" / "counts").exists()
    main([*args, "--no_vocabulary_file", "--experiment_name", "bare"])
    assert (tmp_path / "bare" / "counts").exists() and not (tmp_path / "bare" / "vocabulary").exists()
    with pytest.raises(SystemExit):
        main([*args, "--tokenizer_name", "word-piece"])


def test_system_statistics(spark):
    from lexibond.plans.logged import executor_memory, machine

    has = machine()
    assert has["cores"] >= 1 and has["memory"] >= has["memory_free"] > 0 and has["disk"] >= has["disk_free"] > 0
    assert executor_memory(spark).first()["storage_bytes"] > 0


def test_arrow_tables_are_corpora(spark):
    import pyarrow as pa

    table = pa.table({"sample_id": [1, 2], "text": ["a b", None]})
    assert [r["tokens"] for r in T.tokenise(sources.from_arrow(spark, table)).collect()] == [["a", "b"], []]
    with pytest.raises(ValueError):
        sources.from_arrow(spark, table.select(["text"]))


def test_sources(spark, corpus_root):
    both = sources.load_corpus(spark, "documents+conversations", corpus_root)
    assert both.count() == 24
    assert [r["sample_id"] for r in sources.load_corpus(spark, "documents", corpus_root, 3).orderBy("sample_id").collect()] == [0, 1, 2]
    assert sources.load_corpus(spark, "documents", corpus_root, 999).count() == 22
    with pytest.raises(NotImplementedError):
        sources.load_corpus(spark, "nothing", corpus_root)
    with pytest.raises(NotImplementedError):
        T.load_tokenizer("nothing")
    with pytest.raises(TypeError):
        sources.union_corpora(sources.read_documents(spark, corpus_root), spark.range(1).select(F.col("id").alias("sample_id"), F.lit(1).alias("text")))


def test_run_writes_a_vocabulary(spark, corpus_root, tmp_path):
    config = MiningConfig("small", "documents", max_ngram_size=3, min_count_threshold=2, vocab_size=10, percents=(60.0, 40.0))
    lazy = {(r["n"], r["rank"]): r["ngram_text"] for r in run(spark, config, corpus_root).vocabulary.collect()}
    done = run_to_file(spark, config, corpus_root, str(tmp_path))
    assert done.vocabulary.count() == len(lazy) == 10
    lines = [r["ngram_text"] for r in sources.read_vocabulary(spark, f"{tmp_path}/small/vocabulary").collect()]
    assert sorted(lines) == sorted(lazy.values())
    assert sources.read_counts(spark, f"{tmp_path}/small/counts").where("n = 1").count() > 0
    totals = {r["n"]: r["total"] for r in sources.read_totals(spark, f"{tmp_path}/small/totals").collect()}
    assert totals[1] > totals[2] > totals[3]


def test_logged_run_can_be_reported(spark, corpus_root, tmp_path, capsys):
    from lexibond.plans.logged import run_logged
    from lexibond.report import print_estimate, print_report

    config = MiningConfig("logged", "documents", max_ngram_size=3, min_count_threshold=2, vocab_size=10, percents=(60.0, 40.0))
    got = run_logged(spark, config, corpus_root, str(tmp_path), str(tmp_path / "run.log"))
    want = run(spark, config, corpus_root).vocabulary
    assert sorted(r["ngram_text"] for r in got.collect()) == sorted(r["ngram_text"] for r in want.collect())
    facts = L.run_facts(L.last_run(L.parse_log(sources.read_log_lines(spark, str(tmp_path / "run.log"))), "logged")).first()
    assert facts["complete"] and facts["n_tokens"] == 150
    # a second run in the same process, with a log of its own
    run_logged(spark, config, corpus_root, str(tmp_path), str(tmp_path / "second.log"), clean_up=True)
    for name in ("run.log", "second.log"):
        again = L.last_run(L.parse_log(sources.read_log_lines(spark, str(tmp_path / name))), "logged")
        assert L.run_facts(again).first()["complete"] and all(r["pairs"] == 1 for r in L.step_times(again).collect())
    assert sources.read_vocabulary(spark, f"{tmp_path}/logged/vocabulary").count() == 10 and not (tmp_path / "logged" / "scored").exists()
    print_report(spark, str(tmp_path / "run.log"), "logged")
    print_estimate(spark, str(tmp_path / "run.log"), "logged", 10**9, 4)
    assert "| documents | 150 |" in capsys.readouterr().out


def test_stream_counts_equal_batch(spark, tmp_path):
    from lexibond.operators.ngrams import count_ngrams
    from lexibond.streaming import read_sample_stream, stream_counts

    rows = spark.createDataFrame([(i, f"a b c{i % 3}") for i in range(12)], "sample_id long, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    counts = stream_counts(read_sample_stream(spark, f"{tmp_path}/in"), [1, 2])
    q = counts.writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r["ngram"]): r["count"] for r in spark.table("running").collect()}
    want = {tuple(r["ngram"]): r["count"] for r in count_ngrams(T.tokenise(rows), [1, 2]).collect()}
    assert got == want


def parsed(spark, lines):
    return L.parse_log(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string"))


def test_parse_log(spark):
    rows = parsed(spark, [RUN_LINES[0], "not a log line"]).orderBy("line_no").collect()
    assert rows[0]["ts"] == datetime.datetime(2024, 3, 1, 10, 0) and rows[0]["message"] == "start experiment: small"
    assert not rows[1]["parsed"] and rows[1]["message"] is None


def test_unfinished_starts_are_skipped_and_the_last_run_counts(spark):
    again = [line.replace("2024-03-01", "2024-03-05") for line in RUN_LINES]
    run_lines = L.last_run(parsed(spark, RUN_LINES + again), "small")
    assert run_lines.count() == len(RUN_LINES) - 1
    facts = L.run_facts(run_lines).first()
    assert facts["complete"] and facts["n_tokens"] == 5130042 and facts["total_time"] == 430 and facts["total_space"] == 900000
    steps = {r["step"]: (r["pairs"], r["seconds"]) for r in L.step_times(run_lines).collect()}
    assert steps["aggregate_ngram_counts"] == (1, 120) and len(steps) == 7


def test_durations_beyond_a_day_do_not_wrap(spark):
    lines = ["2024-01-01 00:00:00,000 - m - INFO - start", "2024-01-03 01:00:00,000 - m - INFO - end"]
    pairs = L.pair_starts_ends(parsed(spark, lines), F.col("message") == "start", F.col("message") == "end").first()
    assert pairs["seconds"] == 49 * 3600


def test_end_without_start(spark):
    pairs = L.pair_starts_ends(parsed(spark, ["2024-01-01 00:00:00,000 - m - INFO - end"]), F.col("message") == "start", F.col("message") == "end").first()
    assert pairs["start_line"] is None and pairs["seconds"] is None


def test_units(spark):
    values = [(119.99,), (120.0,), (7199.0,), (7200.0,), (180000.0,), (1.005,), (0.125,)]
    got = [r[0] for r in spark.createDataFrame(values, "v double").select(duration_text(F.col("v"))).collect()]
    assert got == ["119.99 seconds", "2.00 minutes", "119.98 minutes", "2.00 hours", "2.08 days", f"{1.005:.2f} seconds", f"{0.125:.2f} seconds"]
    sizes = [(1023.0,), (1024.0,), (5 * 2.0**40,)]
    assert [r[0] for r in spark.createDataFrame(sizes, "v double").select(size_text(F.col("v"))).collect()] == ["1023.00 Bytes", "1.00 KB", "5.00 TB"]


def test_growth(spark):
    one = spark.createDataFrame([(2.0, 8.0, 3.0, "compute_pmi_score")], "a double, b double, v double, s string")
    r = one.select(grow_linear(F.col("a"), F.col("b"), F.col("v")), grow_n_log_n(F.col("a"), F.col("b"), F.col("v")), grow_step(F.col("s"), F.col("a"), F.col("b"), F.col("v")), grow_step(F.lit("?"), F.col("a"), F.col("b"), F.col("v"))).first()
    assert tuple(r) == (12.0, 36.0, 48.0, None)


def test_log_and_totals_round_trip(spark, tmp_path):
    log = run_logger("lexibond.test", str(tmp_path / "log.log"))
    log.info("start")
    row = L.parse_log(sources.read_log_lines(spark, str(tmp_path / "log.log"))).first()
    assert (row["module_name"], row["level"], row["message"]) == ("lexibond.test", "INFO", "start")
    write_totals(spark.createDataFrame([(1, 5)], "n int, total long"), str(tmp_path / "t"))
    assert sources.read_totals(spark, str(tmp_path / "t")).first()["total"] == 5
