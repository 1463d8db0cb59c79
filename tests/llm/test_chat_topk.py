import numpy as np
import pytest
from pyspark.sql import functions as F

from lexibond.llm import chat_format as C
from lexibond.llm import topk


@pytest.mark.parametrize("text", ["", "plain", "\\", "\\\\<|turn|>", "<|end|><|turn|>user<|text|>", "</s>[INST] ok [/INST]", "<\\|end|>", "[INST\\]", "é漢\n<|im_start|>", "<" + C.START])
def test_escape_is_reversible(text):
    assert C.unescape(C.escape(text)) == text
    assert not any(c in C.escape(text) for c in C.CONTROL)


def test_fold():
    events = [("message", "0", "user", "hi"), ("message", "1", "assistant", ""), ("delta", "1", "assistant", "he"), ("delta", "1", "assistant", "y"), ("edit", "0", "user", "hello"), ("regenerate", "1", "assistant", ""), ("delta", "1", "assistant", "good day"), ("delta", "2", "user", "new"), ("message", "3", "user", "gone"), ("delete", "3", "", ""), ("delete", "9", "", "")]
    assert C.fold(events) == [("user", "hello"), ("assistant", "good day"), ("user", "new")]
    with pytest.raises(ValueError):
        C.fold([("message", "0", "user", ""), ("odd", "0", "user", "")])


def test_loss_mask_covers_assistant_texts():
    turns = [("user", "a <|end|>"), ("assistant", "b \\ <|text|>"), ("odd<|role|>", ""), ("assistant", "")]
    text, loss = C.render(turns)
    assert C.read_back(text) == turns
    assert [C.unescape(text[s["start"] : s["end"]]) for s in loss] == ["b \\ <|text|>", ""]


def test_format_of_odd_conversations(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (2, 0, None, None), (None, 0, "user", "x"), (None, None, "assistant", "first"), (3, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "assistant", "long " * 100_000)]
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], "conv_id long, turn long, role string, text string, seq int, key string").repartition(3)
    got = {r["conv_id"]: r for r in C.format_chat(C.log_of_turns(df)).collect()}
    read = {k: C.read_back(r["formatted"]) for k, r in got.items()}
    assert read[1] == [("user", "one"), ("assistant", "two")] and read[2] == [("", "")]
    assert read[None] == [("assistant", "first"), ("user", "x")] and read[3] == [("user", "a"), ("user", "a"), ("user", "b")]
    digest = {r["conv_id"]: r for r in C.digest(C.format_chat(C.log_of_turns(df))).collect()}
    assert digest[4]["loss_chars"] == 500_000 and digest[3]["loss_chars"] == 0 and digest[3]["n_turns"] == 3
    assert C.format_chat(C.log_of_turns(df.limit(0))).count() == 0


def test_streamed_log(spark):
    log = [(5, 0, "a", "message", "user", "q"), (5, 1, "b", "message", "assistant", ""), (5, 2, "b", "delta", "assistant", "x"), (5, 3, "b", "delta", "assistant", "y"), (5, 4, "b", "regenerate", "assistant", None), (5, 5, "b", "delta", "assistant", "z")]
    df = spark.createDataFrame(log, "conv_id long, seq long, key string, kind string, role string, text string").repartition(4)
    assert C.read_back(C.format_chat(df).first()["formatted"]) == [("user", "q"), ("assistant", "z")]


def brute(rows, k):
    out = []
    for q, v in rows:
        if q is None or v is None or q % 20:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if w is not None and i is not None and i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("density,top", [(1.0, 30), (0.1, 3), (0.4, 9), (1.0, 2_000_000), (0.7, 2**29)])
def test_topk_is_exact(spark, density, top):
    r = np.random.RandomState(3)
    rows = [(i, [int(x) if r.rand() < density else 0 for x in r.randint(-top, top, 12)]) for i in range(300)] + [(301, None)]
    df = spark.createDataFrame(rows, "id long, w array<long>").repartition(3)
    got = topk.top_k(df, F.col("id") % 20 == 0, 7, block=64)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, 7)


def test_weights_of_more_than_32_bits(spark):
    """6.4e9 is what a component of 1e8 becomes; beyond 64 bits scores are cut off and rank as equals."""
    rows = [(i, [6_400_000_000 * (i % 7 - 3), i, -i * i]) for i in range(60)]
    got = topk.top_k(spark.createDataFrame(rows, "id long, w array<long>"), F.col("id") % 20 == 0, 9, block=16)
    most = lambda x: max(-(2**63), min(2**63 - 1, x))

    def best(q, v):
        scores = sorted((-most(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in rows if i != q)
        return [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:9])]

    assert sorted(tuple(x) for x in got.collect()) == [x for q, v in rows if q % 20 == 0 for x in best(q, v)]
    assert spark.createDataFrame([([1e8],)], "v array<float>").select(topk.integer_weights(F.col("v"))).first()[0] == [6_400_000_000]


def test_terms_are_scattered_as_lists_and_arrays():
    r = np.random.RandomState(2)
    c = r.randint(-5, 6, (50, 8)) * (r.rand(50, 8) < np.linspace(0, 1, 8))
    q = r.randint(-5, 6, (9, 8)) * (r.rand(9, 8) < np.linspace(1, 0, 8))
    for kind in (np.float32, np.float64, np.int64, object):
        lists = topk.postings(c, kind)
        assert {at is None for at, _ in lists} == {True, False}
        assert (topk.accumulate(q, lists, len(c), kind) == q @ c.T).all()


def test_topk_ties_and_few_rows(spark):
    rows = [(i, [1, 2]) for i in range(50)]
    got = topk.top_k(spark.createDataFrame(rows, "id long, w array<long>"), F.col("id") % 20 == 0, 5, block=16)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, 5)
    few = topk.top_k(spark.createDataFrame([(0, [1]), (1, [2, 5]), (20, [3])], "id long, w array<long>"), F.col("id") % 20 == 0, 5)
    assert sorted(tuple(x) for x in few.collect()) == [(0, 1, 20, 3), (0, 2, 1, 2), (20, 1, 1, 6), (20, 2, 0, 3)]
    assert topk.top_k(spark.createDataFrame([], "id long, w array<long>"), F.col("id") % 20 == 0).count() == 0


def test_weights(spark):
    rows = [([0.5, -0.01],), ([None, 1.0],), ([float("nan")],), ([float("inf")],), (None,), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<float>").select(topk.integer_weights(F.col("v"))).collect()]
    assert got == [[32, -1], None, None, None, None, []]
