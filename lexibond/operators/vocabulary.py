"""Selecting, decoding and comparing vocabularies."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexibond.functions.text import held_names

DIGITS = 6  # scores are ranked as rounded, so that the last bits of a logarithm don't decide


def top_of_size(scored: DataFrame, n: int, k: int) -> DataFrame:
    """The k best n-grams of one size with their rank; ties go to the smaller tokens."""
    return select_vocabulary(scored.where(F.col("n") == n), {n: k})


def select_vocabulary(scored: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """n, rank, ngram, pmi_score: the best of each size up to its quota; a size that falls short isn't made up.

    The largest quota is a literal bound, so Spark keeps at most that many rows a size before the window's shuffle."""
    rounded = scored.where(F.col("n").isin(list(quotas))).select("n", "ngram", F.round("pmi_score", DIGITS).alias("pmi_score"))
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc_nulls_last("pmi_score"), "ngram"))
    ranked = rounded.withColumn("rank", rank).where(F.col("rank") <= max(quotas.values()))
    quota = F.lit(0)
    for n, k in quotas.items():
        quota = F.when(F.col("n") == n, k).otherwise(quota)
    return ranked.where(F.col("rank") <= quota).select("n", "rank", "ngram", "pmi_score")


def spell(tokens: Column, clean_up: bool = False) -> Column:
    """Tokens joined by a blank and ## pieces to their words; clean_up joins punctuation to words too."""
    text = F.regexp_replace(F.array_join(tokens, " "), r" ##(?=\S)", "")
    return F.regexp_replace(text, r" ([.,!?])", "$1") if clean_up else text


def decode(vocab: DataFrame, clean_up: bool = False) -> DataFrame:
    """Adds ngram_text to a vocabulary of tokens."""
    return vocab.withColumn("ngram_text", spell(F.col("ngram"), clean_up))


def name_ids(ngrams: DataFrame, names: DataFrame) -> DataFrame:
    """ngrams (ids in `ngram`) with `named`, their tokens; null for an id without one. Tasks hold the tokens as an array; a
    vocabulary too long for that is joined."""
    held = held_names(names)
    schema = StructType([*ngrams.schema.fields, StructField("named", ArrayType(StringType()))])
    if held is None:
        flat = ngrams.select("ngram", F.posexplode("ngram").alias("pos", "token_id")).distinct().join(names, "token_id", "left")
        spelt = flat.groupBy("ngram").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("s")).select("ngram", F.col("s.token").alias("named"))
        return ngrams.join(spelt, "ngram", "left").select(*schema.names)
    sent, at = ngrams.sparkSession.sparkContext.broadcast(held), ngrams.columns.index("ngram")

    def run(batches):
        for rows in batches:
            ids, known = rows.column(at), sent.value
            flat = ids.flatten().cast(pa.int64())
            inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(known)))
            tokens = known.take(pc.if_else(inside, flat, pa.scalar(None, pa.int64())))
            named = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), tokens)
            yield pa.RecordBatch.from_arrays([*rows.columns, named], names=schema.names)

    return ngrams.mapInArrow(run, schema)


def decode_ids(vocab: DataFrame, names: DataFrame, clean_up: bool = False) -> DataFrame:
    """Adds ngram_text to a vocabulary of ids; `names` has token, token_id."""
    return name_ids(vocab, names).withColumn("ngram_text", spell(F.col("named"), clean_up)).drop("named")


def vocabulary_lines(vocab: DataFrame) -> DataFrame:
    """The texts of a decoded vocabulary, sizes ascending and best first."""
    return vocab.orderBy("n", "rank").select("ngram_text")


def compare_vocabularies(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: what share of each list (repeats counted) the common set of lines is. An empty list has share null."""
    a, b = first.select(F.col(first.columns[0]).alias("v")), second.select(F.col(second.columns[0]).alias("v"))
    tagged = a.select("v", F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select("v", F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    per = tagged.groupBy("v").agg(F.sum("in_a").alias("a"), F.sum("in_b").alias("b"))
    both = F.sum(F.when((F.col("a") > 0) & (F.col("b") > 0), 1).otherwise(0))
    sums = per.agg(both.alias("common"), F.coalesce(F.sum("a"), F.lit(0)).alias("first_size"), F.coalesce(F.sum("b"), F.lit(0)).alias("second_size"))
    share = lambda n: F.when(F.col(n) > 0, F.col("common") / F.col(n))
    return sums.select(F.coalesce("common", F.lit(0)).alias("common"), "first_size", "second_size", share("first_size").alias("first_share"), share("second_size").alias("second_share"))
