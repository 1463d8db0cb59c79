"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibond.llm import bpe_codec, chat_format, jaccard_join, mixing, pii, quality_rules, suffix_dedup, token_counts, topk, url_filter
from lexibond.llm.oracles import llm_oracles as llm_oracles


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files are; not part of this repository."""
    try:
        import public_tokenizers
    except ImportError:
        return f"/opt/tokenizers/{name}"
    return public_tokenizers.path(name)


_KEY = secrets.token_hex(32)


def pii_key(spark: SparkSession) -> str:
    """The key of pseudonyms, the setting lexibond.pii.key. Without it a new one for each process: values are linked within
    its runs, and nobody can invert them afterwards."""
    return spark.conf.get("lexibond.pii.key", None) or _KEY


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(_table(spark, root, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, root: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, root, "documents"), pii_key(spark)).select("doc_id", "n_pii", "text")


def op3_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    return quality_rules.judge(_table(spark, root, "documents"))


def op4_mixing(spark: SparkSession, root: str) -> DataFrame:
    """What the mix takes of each document, counted from the copies in the output shards."""
    mixed = mixing.mix(_table(spark, root, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.size("copies") * F.col("size")).cast("long").alias("taken"))


def op5_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return jaccard_join.near_components(_table(spark, root, "documents"), k=3, num=90, den=100)


def op6_token_counts(spark: SparkSession, root: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, root, "documents"), tokenizer_file(), keep=["doc_id"])


def op7_bpe_codec(spark: SparkSession, root: str) -> DataFrame:
    coded = bpe_codec.encode_decode(_table(spark, root, "documents"), tokenizer_file(), keep=["doc_id"])
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op8_exact_topk(spark: SparkSession, root: str) -> DataFrame:
    vectors = _table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), topk.integer_weights(F.col("embedding")).alias("w"))
    return topk.top_k(vectors, F.col("id") % 20 == 0, 20)


def op9_chat_format(spark: SparkSession, root: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, root, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.digest(chat_format.format_chat(chat_format.log_of_turns(turns)))


# Fixed value: the rules of the query, (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op10_url_filter(spark: SparkSession, root: str) -> DataFrame:
    return url_filter.judge(_table(spark, root, "pages"), URL_RULES)


def pipeline(spark: SparkSession, root: str) -> DataFrame:
    """corpus_pipeline.run, imported late: that module imports this one."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, root)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (pipeline, op1_suffix_dedup, op2_pii, op3_quality_rules, op4_mixing, op5_jaccard_join, op6_token_counts, op7_bpe_codec, op8_exact_topk, op9_chat_format, op10_url_filter)}
