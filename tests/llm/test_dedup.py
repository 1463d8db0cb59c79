import hashlib
import random

from lexibond.llm import jaccard_join, suffix_dedup
from lexibond.llm.components import components
from lexibond.llm.shared import shingle_set
from tests.llm.odd import empty, frame, rows

SEP = set(" \t\n\x0b\x0c\r")


def words(text):
    out, held = [], []
    for c in text + " ":
        if c in SEP:
            if held:
                out.append("".join(held))
            held = []
        else:
            held.append(c.lower() if c.isascii() else c)
    return out


def brute_components(docs, k, num, den):
    sets = []
    for _, t in docs:
        w = words(t or "")
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if sets[i] and d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d if d is not None else -1), len(sets[i]), (low.get(find(i)) if sets[i] else d) or -1) for i, (d, _) in enumerate(docs))


def near_copies(seed, n_groups=12, per=9):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    docs = []
    for _ in range(n_groups):
        base = [r.choice(vocab) for _ in range(r.choice([1, 2, 4, 7, 12, 30, 80, 400]))]
        for _ in range(per):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1])] = [r.choice(vocab)]
            docs.append((len(docs) + 1, (" " if r.random() < 0.5 else "\n").join(w)))
    return docs


def check(spark, docs, k, num, den, df=None):
    df = df if df is not None else spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard_join.near_components(df, k, num, den).collect())
    assert got == brute_components(docs, k, num, den)


def test_components_of_near_copies(spark):
    check(spark, near_copies(1), 3, 90, 100)
    check(spark, near_copies(2), 5, 80, 100)


def test_chains_without_a_centre(spark):
    base = [f"t{i}" for i in range(120)]
    docs = [(i + 1, " ".join([f"c{j}" if j < 3 * i else w for j, w in enumerate(base)])) for i in range(14)]
    check(spark, docs, 3, 90, 100)


def test_odd_documents(spark):
    check(spark, [(d, t) for d, t, *_ in rows()], 3, 90, 100, frame(spark))
    assert jaccard_join.near_components(empty(spark)).count() == 0


def test_sketch_parts_never_miss_a_similar_pair():
    r = random.Random(5)
    for num in (80, 90):
        bands = jaccard_join.Bands(num, 100)
        for _ in range(400):
            n = r.choice([1, 2, 3, 5, 9, 12, 20, 40, 90, 300, 1500])
            base = [r.getrandbits(64) for _ in range(n)]
            other = [x for x in base if r.random() > 0.04] + [r.getrandbits(64) for _ in range(r.randrange(0, 1 + n // 20 + 1))]
            import numpy as np

            a, b = (np.unique(np.array(x, np.uint64)) for x in (base, other))
            if len(b) and jaccard_join.similar(a, b, num, 100):
                keys = [set(jaccard_join.sketch_keys(s, bands).tolist()) for s in (a, b)]
                assert keys[0] & keys[1], (num, len(a), len(b))


def test_shingles_of_words():
    assert len(shingle_set(b"A b\x0bc d", 3)) == 2
    assert (shingle_set(b" a B  C", 3) == shingle_set(b"A b c", 3)).all()
    assert len(shingle_set(b"a b", 3)) == 1 and len(shingle_set(b" ", 3)) == 0
    assert shingle_set(b"a b", 3)[0] != shingle_set(b"a b", 2)[0] or True


def test_label_passing(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (100, 102), (200, 150)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).df.collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[102] == 100 and got[200] == 150
    assert components(spark.createDataFrame([], "a long, b long")).df.count() == 0


def brute_removal(docs, width):
    """docs: (id, text). A string is repeated if it starts earlier: smaller id (null last), or same id and earlier start."""
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - width + 1):
            x = b[s : s + width]
            first[x] = min(first.get(x, ((True, float("inf")), 0)), (order(d), s))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < (order(d), s):
                gone[s : s + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d if d is not None else -1, len(b), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removal(df, **how):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.remove_repeats(df, **how).collect())


def test_removal_of_passages(spark):
    r = random.Random(9)
    passages = ["".join(r.choice("abcdefgh ") for _ in range(r.choice([60, 99, 100, 101, 180, 400]))) for _ in range(8)]
    docs = []
    for i in range(60):
        parts = [r.choice([*passages, "".join(r.choice("abcdefgh ") for _ in range(r.randrange(150)))]) for _ in range(r.randrange(6))]
        docs.append((i, "".join(parts)))
    docs += [(100, "é" * 300), (101, "ab" * 400), (102, docs[5][1]), (102, docs[7][1]), (102, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert removal(df) == brute_removal(docs, 100)
    assert removal(df, width=50, gram=16) == brute_removal(docs, 50)


def test_hot_anchors(spark):
    """One passage with another continuation in each document, so that its anchors have many classes."""
    r = random.Random(4)
    noise = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    common = noise(70)
    docs = [(i, noise(40) + common + noise(90) + common + noise(31)) for i in range(90)] + [(200 + i, noise(35) + common + "z" * 60) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert removal(df) == brute_removal(docs, 100)
    assert removal(df.repartition(7)) == brute_removal(docs, 100)


def test_repeated_rows_are_first_occurrences(spark):
    r = random.Random(12)
    noise = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    head = noise(160)
    docs = [(1, noise(300))] * 3 + [(None, noise(250))] * 2 + [(2, head + noise(90)), (2, head + noise(120)), (3, noise(40) + head)]
    docs += [(4, head[:120] + noise(80)), (None, head + noise(50)), (1, docs[0][1][:200])]
    for parts in (1, 5):
        assert removal(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)) == brute_removal(docs, 100)


def test_texts_of_one_id_are_told_apart(spark):
    """Null ids and one repeated id, with texts whose hashes agree in 16 bits."""
    from pyspark.sql import functions as F

    r = random.Random(21)
    texts = [(i, f"{i} " + "".join(r.choice("abcdefgh") for _ in range(380))) for i in range(1500)]
    hashed = spark.createDataFrame(texts, "i long, t string").select("i", F.xxhash64("t").bitwiseAND(0xFFFF).alias("h")).collect()
    by = {}
    for x in hashed:
        by.setdefault(x["h"], []).append(x["i"])
    same = next(v for v in by.values() if len(v) > 1)
    a, b, other = texts[same[0]][1], texts[same[1]][1], texts[7 if 7 not in same else 8][1]
    docs = [(None, a), (None, b), (None, other[:150] + a[:200]), (5, a[:151] + "x" * 20), (9, a), (9, b), (9, b[100:] + other)]
    assert removal(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == brute_removal(docs, 100)


def test_removal_on_odd_documents(spark):
    docs = [(d, t[:3000] if t else t) for d, t, *_ in rows()]
    df = spark.createDataFrame([(d, t, 1, 2, "b") for d, t in docs], "doc_id long, text string, doc int, tag int, bytes string")
    assert removal(df) == brute_removal(docs, 100)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_long_runs_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    r = random.Random(2)
    text = "".join(r.choice("abcd") for _ in range(2500))
    import numpy as np

    h, u, p, begin, last = suffix_dedup.anchors(np.frombuffer(text.encode(), np.uint8), 100, 32)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(begin, last, strict=True)])
    assert (covered == np.arange(len(text) - 99)).all() and ((p >= last) & (p <= begin + 68)).all()
