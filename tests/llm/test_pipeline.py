import random

import corpus_pipeline as P
from tests.llm.odd import empty, frame

from lexibond.llm.queries import llm_queries


def test_stages_on_odd_documents(spark):
    for make in (frame, empty):
        docs = make(spark).select(*P.COLUMNS)
        for name, stage in P.STAGES:
            out = stage(spark, docs, "")
            if name != "bpe":
                assert out.columns == list(P.COLUMNS)
            out.count()


def test_run(spark, tmp_path):
    r = random.Random(6)
    texts = [" ".join("".join(r.choice("etaoinshr") for _ in range(r.randrange(3, 8))) for _ in range(60)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], "en", "s0", len(texts[i])) for i in range(5)] + [(200, "too short", "en", "s1", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert ids and not ids & {100, 101, 102, 103, 104, 200} and all(r["exact"] for r in got)


def test_stages_equal_brute_force(spark):
    """Every stage against the plain computation on what its predecessor kept."""
    from collections import Counter

    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from lexibond.llm import quality_rules
    from lexibond.llm.queries import tokenizer_file
    from tests.llm.test_dedup import brute_components
    from tests.llm.test_native import brute_statistics, brute_targets, brute_verdicts

    r = random.Random(31)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9)))
    texts = [" ".join(word() for _ in range(r.randrange(30, 120))) for _ in range(110)]
    texts += [t if i % 2 else t.replace(" ", "  ", 3) + " " + word() for i, t in enumerate(texts[:30])]
    texts += [" ".join(word().upper() + "&&&&" for _ in range(60)), "too short", "again and again and again and " * 20, "write to jo.doe@example.com, " + texts[50][:200], ""]
    texts.insert(0, None)  # ids are places from 1
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts) if i]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(P.STAGES)

    first = stages["quality"](spark, df, "")
    kept = sorted(x["doc_id"] for x in first.collect())
    stats = quality_rules.statistics(df, ["doc_id", "source"]).withColumn("base_failed", quality_rules.base_failed()).withColumn("grp", F.col("source"))
    far = brute_verdicts(stats.withColumns(quality_rules.vectors()).collect())
    limit = quality_rules.chi2_quantile(quality_rules.CUTOFF, quality_rules.D)
    base = {i for i, t, *_ in docs for n, _, _, _, again in [brute_statistics(t)] if n >= 10 and 100 * again <= 20 * n}
    assert set(far) == base and kept == sorted(i for i in base if far[i] <= limit)

    second = stages["near_duplicates"](spark, first, "")
    groups = {d: c for d, _, c in brute_components([(i, texts[i]) for i in kept], 5, 80, 100)}
    one = sorted(d for d, c in groups.items() if d == c)
    assert sorted(x["doc_id"] for x in second.collect()) == one and len(one) < len(kept)

    third = stages["personal_data"](spark, second, "")
    new = {x["doc_id"]: x["text"] for x in third.collect()}
    assert all((t != texts[d]) == ("@" in texts[d]) and "jo.doe" not in t for d, t in new.items()) and sorted(new) == one

    fourth = stages["mixing"](spark, third, "")
    times = Counter(x["doc_id"] for x in fourth.collect())
    size = {d: len(t.split()) for d, t in new.items()}
    sizes, taken = Counter(), Counter()
    for d in one:
        sizes[f"s{d % 3}"] += size[d]
        taken[f"s{d % 3}"] += size[d] * times[d]
    goal = brute_targets(sizes)
    assert max(times.values()) <= 2 and all(abs(taken[x] - goal[x]) <= 60 for x in goal)

    library = Tokenizer.from_file(tokenizer_file())
    for x in stages["bpe"](spark, fourth, "").collect():
        assert x["ids"] == library.encode(new[x["doc_id"]], add_special_tokens=False).ids and x["exact"] and x["n_tokens"] == len(x["ids"])


def test_one_row_of_each_group(spark):
    r = random.Random(11)
    text = lambda: " ".join("".join(r.choice("etaoinshr") for _ in range(6)) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (None, a), (None, a + " more"), (None, b), (None, b), (None, b + " more"), (None, c), (2, d), (2, d), (2, d + " more"), (2, e), (None, None), (3, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{n % 2}", len(t or "")) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.near_duplicates(spark, docs.repartition(3), "").collect()
    start = lambda x: (x or "")[:50]
    assert sorted((r["doc_id"] or -1, start(r["text"])) for r in got) == sorted([(1, start(a)), (-1, start(b)), (-1, start(c)), (2, start(d)), (2, start(e)), (-1, ""), (3, ""), (3, "")])


def test_every_operator_is_registered():
    names = llm_queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
