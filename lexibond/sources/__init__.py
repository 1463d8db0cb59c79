"""Readers: corpora behind a registry, count tables, totals, vocabularies and logs."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Loader = Callable[[SparkSession, str], DataFrame]


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/documents.parquet").select(F.col("doc_id").alias("sample_id"), "text")


def read_dialogue(spark: SparkSession, root: str) -> DataFrame:
    """Each conversation turn is a sample; ids are dense enough for batches: conversation * 1000 + turn."""
    t = spark.read.parquet(f"{root}/conversations.parquet")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), "text")


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """Raw web pages, markup included."""
    return spark.read.parquet(f"{root}/pages.parquet").select(F.col("page_id").alias("sample_id"), F.col("html").alias("text"))


def read_benchmark(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/benchmark.parquet").select(F.col("item_id").alias("sample_id"), "text")


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    """A corpus (sample_id, text) or token table (sample_id, tokens) that the driver holds as an Arrow table."""
    if missing := {"sample_id"} - set(table.column_names):
        raise ValueError(f"the table lacks {sorted(missing)}")
    return spark.createDataFrame(table)


def union_corpora(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both corpora as one bag. Text columns must have one type. `source_rank` keeps the order: first corpus first."""
    if first.schema["text"].dataType != second.schema["text"].dataType:
        raise TypeError("the corpora differ in the type of text")
    tag = lambda df, rank: df.select(F.lit(rank).alias("source_rank"), "sample_id", "text")
    return tag(first, 0).unionByName(tag(second, 1))


def read_documents_and_dialogue(spark: SparkSession, root: str) -> DataFrame:
    return union_corpora(read_documents(spark, root), read_dialogue(spark, root))


_CORPORA: dict[str, Loader] = {
    "documents": read_documents,
    "conversations": read_dialogue,
    "pages": read_pages,
    "benchmark": read_benchmark,
    "documents+conversations": read_documents_and_dialogue,
}


def corpus_names() -> list[str]:
    return list(_CORPORA)


def register_corpus(name: str, loader: Loader) -> None:
    _CORPORA[name] = loader


def load_corpus(spark: SparkSession, name: str, root: str, n_samples: int | None = None) -> DataFrame:
    """The named corpus; with n_samples only its first samples by order (all, if it has fewer)."""
    if name not in _CORPORA:
        raise NotImplementedError(f"no corpus is named {name}")
    corpus = _CORPORA[name](spark, root)
    return corpus if n_samples is None else first_samples(corpus, n_samples)


def first_samples(corpus: DataFrame, n: int) -> DataFrame:
    """The first n samples: TakeOrdered, no full sort."""
    order = [c for c in ("source_rank", "sample_id") if c in corpus.columns]
    return corpus.orderBy(*order).limit(n)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Count tables written by sinks.write_counts (one folder for each n)."""
    return spark.read.parquet(path)


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n int, total long").json(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """One n-gram a line, UTF-8."""
    return spark.read.text(path).select(F.col("value").alias("ngram_text"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log with their order. The file's lines are numbered by Spark's position, which follows the file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
