"""Documents with everything that may go wrong: nulls, empty and long texts, repeats, ties, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, doc long, tag int, size int, n_words int, copies int, ids string, kept string, target double, bytes string"


def rows():
    base = "the quick brown fox jumps over the lazy dog and then runs away from the big bad wolf in the dark wood"
    texts = [
        (1, base),
        (2, base),
        (2, base),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, base.upper() + " once more with feeling and some other words to make it longer than before"),
        (7, "lorem " * 30_000),
        (None, base + " but here the end differs a lot: one two three four five six seven eight nine ten"),
        (8, "x" * 70_000),
        (9, "é漢字 \U0001f600 <|endoftext|> " * 40),
        (10, "\n".join(["same line of text"] * 50)),
        (11, "ends in odd \x0b\x0c\r\n spaces  and   tabs\t\t!"),
        (12, "a"),
    ]
    out = []
    for i, (doc, text) in enumerate(texts):
        lang = [None, "en", "de"][i % 3]
        source = ["src0", None, "src1", "src2"][i % 4]
        out.append((doc, text, lang, source, None if text is None else len(text), 1, "k", 2, 3, 4, 5, 6, "i", "kept", 0.5, "b"))
    return out


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
