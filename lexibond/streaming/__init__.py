"""Counts kept up to date from a stream of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibond.functions.text import words
from lexibond.operators.ngrams import ngrams


def stream_counts(samples: DataFrame, sizes: list[int]) -> DataFrame:
    """samples is a streaming table with sample_id and text; running counts of n-grams for update or complete mode."""
    tokens = samples.select("sample_id", words(F.col("text")).alias("tokens"))
    return ngrams(tokens, sizes).groupBy("n", "ngram").agg(F.count(F.lit(1)).alias("count"))


def read_sample_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema("sample_id long, text string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)
