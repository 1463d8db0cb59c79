import base64
import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexibond.llm.bpe_codec import Codec, chunk_ends, encode_decode
from lexibond.llm.bpe_core import Library
from lexibond.llm.queries import tokenizer_file
from lexibond.llm.token_counts import count_tokens, splice
from tests.llm.odd import empty, frame, rows

FILE = tokenizer_file()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    r = random.Random(3)
    out = [t or "" for _, t, *_ in rows()]
    out += ["".join(r.choice("ab \n'.9é漢\x85　\x1c") for _ in range(2000)) for _ in range(10)]
    out += ["".join(r.choice(["<|endoftext|>", " ", "a", "  ", "\n", "'s", "don't", "99", "<|endo"]) for _ in range(500)) for _ in range(10)]
    out += ["".join(r.choice([chr(r.randrange(1, 0x250)) for _ in range(30)] + [" ", "a"]) for _ in range(2000)) for _ in range(10)]
    return out


def test_rank_encoder_agrees_with_the_library(library):
    texts = odd_texts() + [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}9" for c in range(1, 0x250)]
    assert Library.of(FILE).ranks is not None
    for text, ids in zip(texts, Library.of(FILE).encode_many(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk,overlap", [(4000, 200), (200, 100), (100, 64), (70, 66)])
def test_splice_is_exact(library, chunk, overlap):
    for text in odd_texts():
        if len(text) < 20_000:
            assert splice(library, text, chunk, overlap) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("how", [{}, {"mean_bits": 4, "least": 8, "most": 40}])
def test_codec_is_exact_and_round_trips(library, how):
    texts = odd_texts()
    codec = Codec(FILE)
    for _ in range(2):  # the second time from kept chunks
        for text, ids in zip(texts, codec.encode_many(texts, **how), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
            assert codec.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_texts_without_spaces_are_linear(library):
    """CJK prose, one run of letters, white space and signs that no cut is proven in: exact, and no text is encoded twice over."""
    r = random.Random(1)
    prose = "".join(chr(r.randrange(0x4E00, 0x9FA5)) + ("\u3002" if r.random() < 0.05 else "") for _ in range(60_000))
    texts = [prose, prose.replace("\u3002", ""), "\n \t \x0b " * 8_000, "\U0001f600 \u0301" * 8_000, "<|endoftext|>" * 2_000 + "," * 20_000, base64.b64encode(r.randbytes(60_000)).decode()]
    codec = Codec(FILE)
    seen = []
    plain = codec.library.encode_many
    codec.library = type("Counting", (), {"encode_many": staticmethod(lambda ts: (seen.extend(map(len, ts)), plain(ts))[1])})
    for text in texts:
        seen.clear()
        assert codec.encode_many([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert sum(seen) <= 2.5 * len(text)


def test_proven_cuts_change_nothing(library):
    codec = Codec(FILE)
    for text in odd_texts():
        cuts = codec.cuts(text)[:40]
        for at in cuts:
            a, b = (library.encode(x, add_special_tokens=False).ids for x in (text[:at], text[at:]))
            assert a + b == library.encode(text, add_special_tokens=False).ids


def test_decode_of_broken_utf8(library):
    ids = [i for i in range(300)]
    assert Codec(FILE).decode(np.array(ids)).decode() == library.decode(ids, skip_special_tokens=False)


def test_chunks_follow_content():
    shared = " ".join(f"word{i}" for i in range(400)).encode()
    a, b = b"one two three " + shared, b"quite another beginning of a text " + shared
    cut = lambda t: {t[x:y] for x, y in zip([0, *chunk_ends(t)], chunk_ends(t), strict=False)}
    assert len(cut(a) & cut(b)) >= len(cut(a)) - 3
    assert b"".join(a[x:y] for x, y in zip([0, *chunk_ends(a)], chunk_ends(a), strict=False)) == a


def test_queries_on_odd_documents(spark, library):
    counts = count_tokens(frame(spark), FILE, chunk=5_000, overlap=64, keep=["doc_id"])
    assert counts.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((d or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows())
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in counts.collect()) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in counts.collect())
    coded = encode_decode(frame(spark), FILE)
    assert {"node", "doc_id", "decoded"} <= set(coded.columns) and "text" not in coded.columns
    got = sorted((r["doc_id"] or -1, len(r["ids"]), hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in coded.collect())
    assert got == sorted((d or -1, len(library.encode(t or "", add_special_tokens=False).ids), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in rows())


def test_empty_tables(spark):
    assert count_tokens(empty(spark), FILE).count() == 0
    assert encode_decode(empty(spark), FILE).count() == 0
