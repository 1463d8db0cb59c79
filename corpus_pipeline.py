"""The corpus pipeline: five stages over documents, each a written table that the next one reads.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
documents; the last returns the encoded corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibond.llm import bpe_codec, jaccard_join, mixing, pii, quality_rules
from lexibond.llm.queries import pii_key, tokenizer_file
from lexibond.llm.shared import Table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; rows of equal id and text have one verdict for each language and source. Null and
    short texts go, null languages and sources are groups of their own, an empty table stays empty."""
    own = [F.coalesce(F.col(c), F.lit("\x00")) for c in ("lang", "source")]
    keyed = docs.withColumn("_key", F.xxhash64(mixing.document_key(), *own))
    kept = quality_rules.judge(keyed, keep=["_key"]).where("kept").select("_key").distinct()
    return keyed.join(kept, "_key", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id (rows without one come last), then text hash, then
    the other columns. Texts without words are no duplicates and stay."""
    found = jaccard_join.near_components(docs, k=5, num=80, den=100, keep=("hash", "label"))
    rows = found.where(F.col("n_shingles") > 0).groupBy("label", "doc_id", "hash").agg(F.count(F.lit(1)).alias("rows"))
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash", "rows")).alias("m")).select("m.doc_id", "m.hash", "m.rows")
    bare = found.where(F.col("n_shingles") == 0).select("doc_id", "hash", F.lit(1).cast("long").alias("rows")).distinct()
    keep = first.unionByName(bare).toDF("_id", "_hash", "_rows")
    keyed = docs.select(*COLUMNS).withColumn("_text", F.xxhash64("text"))
    hit = keyed.join(keep, keyed["doc_id"].eqNullSafe(keep["_id"]) & (keyed["_text"] == keep["_hash"]))
    # few have several rows of one id and text; of those one is left
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    repeated = hit.where(F.col("_rows") > 1).groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_row")).select("doc_id", "text", "_row.*")
    return hit.where(F.col("_rows") == 1).select(*COLUMNS).unionByName(repeated.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms; null texts stay null, repeated rows are changed alike."""
    return pii.pseudonymise(docs, pii_key(spark)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as its output shards: a row for every time that a shard draws a document, shard after shard in drawn order.
    Repeated rows are drawn alike, as often as any of them. An empty or null text is never drawn."""
    drawn = mixing.mix(docs).where(F.size("copies") > 0).groupBy("key").agg(F.max_by("copies", F.size("copies")).alias("copies"))
    keyed = docs.withColumn("key", mixing.document_key())
    rows = keyed.join(drawn, "key").select(*COLUMNS, F.inline("copies"))
    return rows.repartition("shard").sortWithinPartitions("shard", "order", "doc_id").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and whether they decode to the text; a null text is empty, repeated rows repeat."""
    coded = bpe_codec.encode_decode(docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256)), tokenizer_file(), keep=["doc_id", "source", "_sha"])
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("_sha")).alias("exact"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixed), ("bpe", encoded)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = []
    for name, stage in STAGES:
        tables.append(Table(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        docs = tables[-1].df
    for table in tables[:-1]:
        table.drop()
    return docs
