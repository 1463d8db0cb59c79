"""Normalising, tokenising and ids; tokenizers behind a registry."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from lexibond.tables import Table

# The split of text into words and single punctuation marks, and the special tokens in the order of their ids.
WORD_PATTERN = r"[\p{P}$+<=>^`|~]|[^\s\p{P}$+<=>^`|~]+"
SPECIALS = ("[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]")
WORD_LEVEL_CAP = 500_000
HELD_CHARS = 64_000_000  # of a vocabulary that tasks hold as an array

_PLAIN = r"[^\t\n\r\x20-\x7E]"  # texts without these are only lower-cased
# The ranges of Latin letters, signs and dashes that hold no control character, white space, lone mark or sign
# that stands apart. Texts of these and plain ones only need single letters replaced.
_LATIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_LATIN_BASE = "aaaaaaceeeeiiiinooooouuuuyy"
SIMPLE = ((0xA1, 0xAC), (0xAE, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC))


def _only(ranges: tuple[tuple[int, int], ...]) -> str:
    """A pattern for whole texts of plain characters and these. Those below 0x100 are named one by one: the JVM looks them up in a
    table, some 40 times as fast as it searches for any other character by ranges."""
    short = [0x9, 0xA, 0xD, *range(0x20, 0x7F), *(c for low, high in ranges for c in range(low, min(high, 0xFF) + 1))]
    table = "[" + "".join(f"\\u{c:04X}" for c in short) + "]*+"
    others = "".join(f"\\u{max(low, 0x100):04X}-\\u{high:04X}" for low, high in ranges if high > 0xFF)
    return rf"\A{table}(?:[{others}]++{table})*+\z"


_WESTERN = _only(tuple((low, min(high, 0xFF)) if low < 0x100 else (low, high) for low, high in SIMPLE))  # texts of these hold no other letter with an accent
_SIMPLE = _only(SIMPLE)
_CONTROL = r"[\p{C}\uFFFD&&[^\t\n\r]]"
_MARKS = r"\p{Mn}"
# The blocks whose signs stand apart as words.
_APART = r"([\u4E00-\u9FFF\u3400-\u4DBF\uF900-\uFAFF\x{20000}-\x{2A6DF}\x{2A700}-\x{2B81F}\x{2B920}-\x{2CEAF}\x{2F800}-\x{2FA1F}])"


@cache
def base_letters() -> tuple[str, str, dict[str, str]]:
    """By the rule of canonical decomposition without marks: letters and what each becomes, and those that become several.
    Hangul syllables follow their own rule."""
    letters, plain, longer = [], [], {}
    for code in range(0x110000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code <= 0xD7A3 or unicodedata.category(c) == "Mn":
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            letters.append(c)
            plain.append(base)
        elif base != c:
            longer[c] = base
    return "".join(letters), "".join(plain), longer


def _syllables(text: Column) -> Column:
    """Hangul syllables as the letters they are made of."""
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int") - 0xAC00
    letter = lambda first, n, i: F.substr(F.lit("".join(chr(first + j) for j in range(n))), i + 1, F.lit(1))
    parts = lambda c: F.concat(letter(0x1100, 19, F.floor(code(c) / 588).cast("int")), letter(0x1161, 21, F.floor(code(c) % 588 / 28).cast("int")), F.when(code(c) % 28 > 0, letter(0x11A8, 27, code(c) % 28 - 1)).otherwise(""))
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.between("\uac00", "\ud7a3"), parts(c)).otherwise(c)), "")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _folded(text: Column) -> Column:
    """Any text, the long way."""
    letters, plain, longer = base_letters()
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _CONTROL, ""), r"\p{Z}", " "), _APART, " $1 ")

    def several(c: Column) -> Column:
        out = c
        for letter, base in longer.items():
            out = F.replace(out, F.lit(letter), F.lit(base))
        return F.when(c.rlike("[" + "".join(longer) + "]"), out).otherwise(c)

    spelt = _bound(clean, lambda c: F.when(c.rlike("[\uac00-\ud7a3]"), _syllables(c)).otherwise(c))
    return F.lower(F.regexp_replace(F.translate(_bound(spelt, several), letters, plain), _MARKS, ""))


def normalise(text: Column) -> Column:
    """Lower-cased and without accents; control characters go, every white space is a blank, CJK signs stand apart. In the JVM:
    only texts beyond SIMPLE characters take the long way."""
    letters, plain, _ = base_letters()
    some = [(c, base) for c, base in zip(letters, plain, strict=True) if any(low <= ord(c) <= high for low, high in SIMPLE)]
    short = F.lower(F.translate(text, "".join(c for c, _ in some), "".join(base for _, base in some)))
    western = F.lower(text)  # replacing a few letters one by one is some ten times as fast as translate
    for letter, base in zip(_LATIN, _LATIN_BASE, strict=True):
        western = F.replace(western, F.lit(letter), F.lit(base))
    return F.when(~text.rlike(_PLAIN), F.lower(text)).when(text.rlike(_WESTERN), western).when(text.rlike(_SIMPLE), short).otherwise(_folded(text))


def words(text: Column) -> Column:
    """Normalised words and punctuation marks, in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(normalise(text), F.lit(WORD_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def tokenise(corpus: DataFrame) -> DataFrame:
    """sample_id, tokens (array of string)."""
    return corpus.select("sample_id", words(F.col("text")).alias("tokens"))


PART_TOKENS = 1_000_000  # about so many tokens are one row of a coded corpus


def _coded(held: list[tuple[pa.Array, np.ndarray, pa.Array]]) -> pa.RecordBatch:
    """Samples, their numbers of tokens, and all tokens in a row -> one row of a coded corpus."""
    ids, lengths = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
    flat = pa.concat_arrays([h[2] for h in held]).dictionary_encode()
    codes, words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32), flat.dictionary
    whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    counts = pa.array(np.bincount(codes, minlength=len(words)).astype(np.int64))
    parts = [whole(ids), whole(pa.array(lengths.astype(np.int32))), pa.array([codes.tobytes()], pa.binary()), whole(words), whole(counts)]
    return pa.RecordBatch.from_arrays(parts, names=["sample_id", "lengths", "codes", "words", "counts"])


def _coded_parts(cut, most: int):
    """(samples, where the tokens of each end, tokens), again and again -> rows of a coded corpus."""
    held, size = [], 0
    for ids, upto, tokens in cut:
        at = 0
        while at < len(ids):
            # up to the sample that fills the part
            end = min(len(ids), int(np.searchsorted(upto, upto[at] + most - size, side="left")))
            end = max(end, at + 1)
            held.append((ids.slice(at, end - at), np.diff(upto[at : end + 1]), tokens.slice(int(upto[at] - upto[0]), int(upto[end] - upto[at]))))
            size += int(upto[end] - upto[at])
            at = end
            if size >= most:
                yield _coded(held)
                held, size = [], 0
    if held:
        yield _coded(held)


def _coded_kind(sample: str) -> str:
    return f"sample_id array<{sample}>, lengths array<int>, codes binary, words array<string>, counts array<long>"


def code_words(tokenised: DataFrame) -> DataFrame:
    """A tokenised corpus in rows of whole samples with a dictionary each: sample_id, lengths (arrays by sample), codes (32-bit
    places in `words`, as bytes), words and their counts. Every text is tokenised once; words are counted and get ids by dictionary."""
    most = PART_TOKENS

    def run(batches):
        def cut():
            for rows in batches:
                tokens = pc.fill_null(rows.column(1), []) if rows.column(1).null_count else rows.column(1)
                yield rows.column(0), tokens.offsets.to_numpy(), tokens.flatten()

        yield from _coded_parts(cut(), most)

    return tokenised.select("sample_id", "tokens").mapInArrow(run, _coded_kind(tokenised.schema["sample_id"].dataType.simpleString()))


CUT_BYTES = 4_000_000  # of text that a task cuts at once
_BLANK, _LETTER, _SIGN, _REST = range(4)  # of a byte; _REST goes on with a sign


@cache
def _byte_rules() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts of plain and western characters, in UTF-8: each byte lower-cased and its kind; by its second byte, the letter that one
    behind 0xC3 becomes (below 0x80 a single byte); which behind 0xC2, and by the bits of two more which behind 0xE2, are punctuation."""
    sign = lambda c: c in "$+<=>^`|~" or unicodedata.category(c)[0] == "P"
    lower, kinds = np.arange(256, dtype=np.uint8), np.full(256, _LETTER, np.uint8)
    for i in range(128):
        lower[i] = ord(chr(i).lower())
        kinds[i] = _BLANK if chr(i) in "\t\n\r " else _SIGN if sign(chr(i)) else _LETTER
    base = dict(zip(_LATIN, _LATIN_BASE, strict=True))
    latin = np.arange(256, dtype=np.uint8)
    for i in range(0x80, 0xC0):
        small = chr(i + 0x40).lower()
        latin[i] = base.get(small, small).encode()[-1]
    after_c2 = np.array([0xA1 <= i < 0xC0 and sign(chr(i)) for i in range(256)])
    after_e2 = np.array([any(low <= 0x2000 + i <= high for low, high in SIMPLE) and sign(chr(0x2000 + i)) for i in range(4096)])
    return lower, kinds, latin, after_c2, after_e2


def _cut_bytes(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 of texts in a row, and where each starts -> the bytes of all tokens in a row, where each token starts, and how many
    tokens stand before each text and in all."""
    lower, kinds, latin, after_c2, after_e2 = _byte_rules()
    kind, text, gone = kinds[text], lower[text], None
    at = np.flatnonzero(text >= 0xC2)
    if len(at):
        lead = text[at]
        c3 = at[lead == 0xC3]
        letter = latin[text[c3 + 1]]
        short = letter < 0x80
        text[c3 + 1] = letter
        gone = c3[short]  # of two bytes one stays
        c2 = at[lead == 0xC2]
        c2 = c2[after_c2[text[c2 + 1]]]
        e2 = at[lead == 0xE2]
        e2 = e2[after_e2[(text[e2 + 1] & 0x3F).astype(np.int32) << 6 | text[e2 + 2] & 0x3F]]
        kind[c2], kind[c2 + 1], kind[e2], kind[e2 + 1], kind[e2 + 2] = _SIGN, _REST, _SIGN, _REST, _REST
    letters = kind == _LETTER
    first = letters.copy()
    first[1:] &= ~letters[:-1]
    inside = starts[starts < len(text)]
    first[inside] = letters[inside]  # no word goes on into the next text
    first |= kind == _SIGN
    kept = kind != _BLANK
    if gone is not None:
        first[gone + 1], first[gone], kept[gone] = first[gone], False, False
    return text[kept], np.flatnonzero(first[kept]), np.searchsorted(np.flatnonzero(first), starts)


def code_texts(corpus: DataFrame) -> DataFrame:
    """code_words(tokenise(corpus)) without a string for each token: tasks cut the bytes of plain and western texts as `words` does.
    Other texts are cut by `words`, and their tokens, which hold no blank, go to the tasks with blanks between them."""
    most, size = PART_TOKENS, CUT_BYTES
    whole = F.coalesce("text", F.lit(""))
    text = F.when(whole.rlike(_WESTERN), whole).otherwise(F.array_join(words(whole), " "))

    def run(batches):
        def cut():
            for rows in batches:
                ids, texts = rows.column(0), rows.column(1).cast(pa.string())
                if not len(texts):
                    continue
                upto = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
                every = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
                at = 0
                while at < len(texts):
                    end = max(at + 1, int(np.searchsorted(upto, upto[at] + size, side="right")) - 1)
                    data, first, before = _cut_bytes(every[upto[at] : upto[end]], upto[at : end + 1] - upto[at])
                    offsets = np.append(first, len(data)).astype(np.int32)
                    yield ids.slice(at, end - at), before, pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data))
                    at = end

        yield from _coded_parts(cut(), most)

    return corpus.select("sample_id", text.alias("text")).mapInArrow(run, _coded_kind(corpus.schema["sample_id"].dataType.simpleString()))


def count_coded(parts: DataFrame) -> DataFrame:
    """token, count."""
    return parts.select(F.inline(F.arrays_zip("words", "counts"))).toDF("token", "count").groupBy("token").agg(F.sum("count").alias("count"))


def merge_word_counts(counted: list[DataFrame]) -> DataFrame:
    """token, count over several corpora."""
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out.groupBy("token").agg(F.sum("count").alias("count"))


def _looked_up(parts: DataFrame, vocabulary: DataFrame, other: int, kind: str, row) -> DataFrame:
    """A coded corpus whose words become ids; words that the vocabulary lacks get `other`. Only dictionaries are looked up, in
    an array that tasks hold, or by a join where the vocabulary is longer than HELD_CHARS. row: (a row's samples, lengths and ids
    of its tokens) -> Arrow batches of `kind`."""
    names = held_names(vocabulary)
    if names is None:
        keyed = parts.withColumn("part", F.sha2(F.concat_ws(",", F.col("sample_id").cast("array<string>"), F.sha2("codes", 256), F.array_join("words", " ")), 256))
        single = keyed.select("part", "words").dropDuplicates(["part"])
        found = single.select("part", F.posexplode("words").alias("pos", "token")).join(vocabulary, "token", "left")
        found = found.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("token_id", F.lit(other)).cast("int").alias("id")))).alias("s"))
        looked = keyed.join(found, "part", "left").select("sample_id", "lengths", "codes", F.coalesce("s.id", F.array().cast("array<int>")).alias("words"))
    else:
        looked = parts.select("sample_id", "lengths", "codes", "words")
    sent = parts.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        for rows in batches:
            found = rows.column(3).flatten()
            if sent.value is not None:
                found = pc.fill_null(pc.index_in(found.cast(pa.string()), value_set=sent.value), other)
            found, starts = found.to_numpy(zero_copy_only=False).astype(np.int32), rows.column(3).offsets.to_numpy()
            for i in range(rows.num_rows):
                ids = found[starts[i] - starts[0] : starts[i + 1] - starts[0]][np.frombuffer(rows.column(2)[i].as_buffer(), np.int32)]
                yield from row(rows.column(0)[i].values, rows.column(1)[i].values, ids)

    return looked.mapInArrow(run, kind)


def ids_of_parts(parts: DataFrame, vocabulary: DataFrame, other: int = 0) -> DataFrame:
    """sample_id, input_ids of a coded corpus; words that the vocabulary lacks get `other`."""

    def row(samples, lengths, ids):
        ends = pa.array(np.concatenate([[0], np.cumsum(lengths.to_numpy())]).astype(np.int32))
        out = pa.RecordBatch.from_arrays([samples, pa.ListArray.from_arrays(ends, pa.array(ids))], names=["sample_id", "input_ids"])
        for at in range(0, out.num_rows, ROWS):
            yield out.slice(at, ROWS)

    kind = parts.schema["sample_id"].dataType.elementType.simpleString()
    return _looked_up(parts, vocabulary, other, f"sample_id {kind}, input_ids array<int>", row)


ROWS = 1024  # of texts in an Arrow batch that goes to the JVM


def count_words(tokenised: DataFrame) -> DataFrame:
    """token, count. Tasks count in Arrow arrays before the shuffle."""
    return count_coded(code_words(tokenised))


def train_word_level(corpus: DataFrame, cap: int = WORD_LEVEL_CAP) -> DataFrame:
    """token, token_id: specials first, then words by count descending and word ascending, `cap` ids in all."""
    return number_words(count_words(tokenise(corpus)), cap)


def number_words(counted: DataFrame, cap: int = WORD_LEVEL_CAP) -> DataFrame:
    """token, count -> token, token_id. No task sees more than a share of the words, whatever their number: a histogram of
    counts says down to which count all words are kept, and of the words of that count the first are found by ranges."""
    spark, room = counted.sparkSession, cap - len(SPECIALS)
    table = Table(counted, "words")
    kept = table.df
    ties = None
    if table.df.count() > room:
        levels = Table(table.df.groupBy("count").agg(F.count(F.lit(1)).alias("words")), "levels")
        upto = F.sum("words").over(Window.orderBy(F.desc("count")))
        last = levels.df.withColumn("upto", upto).where(F.col("upto") >= room).agg(F.max(F.struct("count", "upto", "words")).alias("m")).select("m.*").first()
        above, left = last["upto"] - last["words"], room - (last["upto"] - last["words"])
        kept = table.df.where(F.col("count") > last["count"]) if above else table.df.limit(0)
        ranged = table.df.where(F.col("count") == last["count"]).repartitionByRange("token").withColumn("range", F.spark_partition_id())
        ties = Table(ranged, "ties")
        sizes = sorted((r["range"], r["n"]) for r in ties.df.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())
        whole, before = [], 0
        for at, n in sizes:
            if before + n > left:
                kept = kept.unionByName(ties.df.where(F.col("range") == at).orderBy("token").limit(left - before).drop("range"))
                break
            whole.append(at)
            before += n
        kept = kept.unionByName(ties.df.where(F.col("range").isin(whole)).drop("range"))
        levels.drop()
    # `cap` words at most, so the driver may number them
    held = kept.select("token", "count").toArrow()
    held = held.take(pc.sort_indices(held, sort_keys=[("count", "descending"), ("token", "ascending")]))
    names = held.column("token").cast(pa.string()).combine_chunks()
    table.drop()
    if ties:
        ties.drop()
    tokens = pa.concat_arrays([pa.array(SPECIALS, pa.string()), names])
    out = spark.createDataFrame(pa.table({"token": tokens, "token_id": pa.array(range(len(tokens)), pa.int32())}))
    _HELD[out] = tokens
    return out


def frequent_words(counted: DataFrame, least: int) -> DataFrame:
    """token, token_id, count of the words found `least` times or more, which number as in the whole vocabulary: no cap."""
    table = Table(counted.where(F.col("count") >= least), "words")
    if (table.df.agg(F.sum(F.length("token"))).first()[0] or 0) > HELD_CHARS:
        return rank_words(table.df)
    held = table.df.select("token", "count").toArrow()
    held = held.take(pc.sort_indices(held, sort_keys=[("count", "descending"), ("token", "ascending")]))
    table.drop()
    names = held.column("token").cast(pa.string()).combine_chunks()
    first = len(SPECIALS)
    out = counted.sparkSession.createDataFrame(pa.table({"token": names, "token_id": pa.array(range(first, first + len(names)), pa.int32()), "count": held.column("count")}))
    _HELD[out] = pa.concat_arrays([pa.nulls(first, pa.string()), names])
    return out


def rank_words(counted: DataFrame) -> DataFrame:
    """token, token_id, count of all words, by count descending and word ascending from the first id behind the specials. They are
    sorted by range and numbered range by range, so the vocabulary is never in one place."""
    base = Table(counted.orderBy(F.desc("count"), "token").select("token", "count", F.monotonically_increasing_id().alias("_at")), "ranked")
    part = F.shiftright("_at", 33)
    sizes = base.df.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    before, rows = len(SPECIALS), []
    for r in sizes:
        rows.append((r["_part"], before - (r["_part"] << 33)))
        before += r["n"]
    shift = counted.sparkSession.createDataFrame(rows, "_part long, _shift long")
    return base.df.withColumn("_part", part).join(F.broadcast(shift), "_part").select("token", (F.col("_at") + F.col("_shift")).alias("token_id"), "count")


_HELD: WeakKeyDictionary[DataFrame, pa.Array] = WeakKeyDictionary()


def held_names(vocabulary: DataFrame) -> pa.Array | None:
    """The tokens of a vocabulary (token, token_id; capped) by id, null for ids it lacks; None if they are too long to hold."""
    if vocabulary not in _HELD:
        if (vocabulary.agg(F.sum(F.length("token"))).first()[0] or 0) > HELD_CHARS:
            return None
        known = vocabulary.select("token", "token_id").toArrow()
        at, names = known.column("token_id").to_numpy(), known.column("token").cast(pa.string()).combine_chunks()
        places = np.full(int(at.max(initial=-1)) + 1, -1)
        places[at] = np.arange(len(at))
        _HELD[vocabulary] = names.take(pa.array(places, mask=places < 0))
    return _HELD[vocabulary]


def encode(tokenised: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """sample_id, input_ids: unknown words get the id of [UNK]. A vocabulary is capped; one of HELD_CHARS at most is an
    array that tasks look words up in, a longer one (very long words) is joined."""
    names = held_names(vocabulary)
    if names is None:
        return encode_by_join(tokenised, vocabulary)
    sent = tokenised.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        for rows in batches:
            tokens = rows.column(1)
            ids = pc.fill_null(pc.index_in(tokens.flatten().cast(pa.string()), value_set=sent.value), 0)
            starts = pc.subtract(tokens.offsets, tokens.offsets[0])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(starts, ids)], names=["sample_id", "input_ids"])

    kind = tokenised.schema["sample_id"].dataType.simpleString()
    return tokenised.select("sample_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).mapInArrow(run, f"sample_id {kind}, input_ids array<int>")


def encode_by_join(tokenised: DataFrame, vocabulary: DataFrame) -> DataFrame:
    flat = tokenised.select("sample_id", F.posexplode_outer("tokens").alias("pos", "token"))
    coded = flat.join(vocabulary, "token", "left").select("sample_id", "pos", F.when(F.col("token").isNotNull(), F.coalesce("token_id", F.lit(0))).alias("token_id"))
    packed = coded.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "token_id")))).alias("seq"))
    return packed.select("sample_id", F.col("seq.token_id").alias("input_ids"))


def split_pieces(word: str, pieces: dict[str, int], longest: int = 100) -> list[str]:
    """The longest known pieces from left to right; [UNK] for a word that can't be covered."""
    out, start = [], 0
    while start < len(word) <= longest:
        for end in range(len(word), start, -1):
            piece = ("##" if start else "") + word[start:end]
            if piece in pieces:
                out.append(piece)
                start = end
                break
        else:
            return [SPECIALS[0]]
    return out if len(word) <= longest else [SPECIALS[0]]


def word_piece(pieces: dict[str, int]):
    """An Arrow UDF from words to the ids of their pieces; `pieces` is a user's vocabulary file."""
    unknown = pieces.get(SPECIALS[0], 0)

    @F.pandas_udf(ArrayType(IntegerType()))
    def cut(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ws: [pieces.get(p, unknown) for w in ws for p in split_pieces(w, pieces)])

    return cut


def word_piece_spec(pieces: dict[str, int]) -> TokenizerSpec:
    """A tokenizer of a given vocabulary of word pieces; continued pieces begin with ## and are joined again by decoding."""
    cut = word_piece(pieces)

    def ids(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
        table = corpus.sparkSession.createDataFrame(list(pieces.items()), "token string, token_id int")
        return tokenise(corpus).select("sample_id", cut("tokens").alias("input_ids")), table

    return TokenizerSpec("word-piece", ids)


def load_word_pieces(spark: SparkSession, path: str) -> dict[str, int]:
    """token -> id from a vocab file of one token a line (a tokenizer's file: tens of thousands of lines)."""
    lines = spark.read.text(path, wholetext=True).first()[0].split("\n")
    return {token.rstrip("\r"): i for i, token in enumerate(lines) if token}


@dataclass(frozen=True)
class TokenizerSpec:
    """ids: corpus -> (sample_id, input_ids) and the vocabulary (token, token_id), which is trained where it isn't given."""

    name: str
    ids: Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def word_level_ids(corpus: DataFrame, cap: int = WORD_LEVEL_CAP) -> tuple[DataFrame, DataFrame]:
    parts = Table(code_texts(corpus), "coded").df
    vocabulary = number_words(count_coded(parts), cap)
    return ids_of_parts(parts, vocabulary), vocabulary


NO_WORD = -1  # stands for every word that is too rare; no n-gram holds it


def frequent_ids(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """sample_id, tokens: ids of frequent words, NO_WORD for others."""
    return ids_of_parts(parts, vocabulary, NO_WORD).withColumnRenamed("input_ids", "tokens")


def packed_ids(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The tokens of frequent_ids, a row for each row of the coded corpus: lengths (array by sample) and tokens (32-bit ids, as
    bytes), which the JVM neither writes nor reads one by one."""

    def row(samples, lengths, ids):
        whole = pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), lengths)
        yield pa.RecordBatch.from_arrays([whole, pa.array([ids.tobytes()], pa.binary())], names=["lengths", "tokens"])

    return _looked_up(parts, vocabulary, NO_WORD, "lengths array<int>, tokens binary", row)


_TOKENIZERS = {"word-level": TokenizerSpec("word-level", word_level_ids)}


def register_tokenizer(spec: TokenizerSpec) -> None:
    _TOKENIZERS[spec.name] = spec


def tokenizer_names() -> list[str]:
    return list(_TOKENIZERS)


def load_tokenizer(name: str) -> TokenizerSpec:
    if name not in _TOKENIZERS:
        raise NotImplementedError(f"no tokenizer is named {name}")
    return _TOKENIZERS[name]
