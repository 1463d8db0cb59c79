"""A mining run from corpus to vocabulary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibond.config import MiningConfig
from lexibond.functions.text import load_tokenizer
from lexibond.operators import ngrams as G
from lexibond.operators.scoring import scores
from lexibond.operators.vocabulary import decode_ids, select_vocabulary
from lexibond.sources import load_corpus
from lexibond.sources.sinks import delete_folder, write_counts, write_totals, write_vocabulary
from lexibond.tables import Table


@dataclass
class MiningRun:
    """Every stage as a table; n-grams are arrays of token ids, `names` has the tokens of ids."""

    tokens: DataFrame
    names: DataFrame
    totals: DataFrame
    counts: DataFrame
    scored: DataFrame
    vocabulary: DataFrame


def token_ids(corpus: DataFrame, tokenizer: str = "word-level") -> tuple[DataFrame, DataFrame]:
    """sample_id, tokens (ids; a written table) and the vocabulary trained on this corpus or given with the tokenizer.
    Words beyond a vocabulary's cap are [UNK], which is counted like any token."""
    ids, names = load_tokenizer(tokenizer).ids(corpus)
    return Table(ids.select("sample_id", F.col("input_ids").alias("tokens")), "ids").df, names


def count(tokens: DataFrame, config: MiningConfig) -> DataFrame:
    if config.min_count_batch_threshold > 1:
        return G.count_in_batches(tokens, list(range(1, config.max_ngram_size + 1)), config.batch_size, config.min_count_batch_threshold, config.min_count_threshold)
    return G.count_id_ngrams(tokens, config.max_ngram_size, config.min_count_threshold)


def run(spark: SparkSession, config: MiningConfig, root: str, work: str | None = None) -> MiningRun:
    """With `work`, totals and counts are written there."""
    tokens, names = token_ids(load_corpus(spark, config.dataset_name, root, config.n_samples), config.tokenizer_name)
    totals, counts = G.totals(tokens, config.max_ngram_size), count(tokens, config)
    if work:
        at = config.output_path(work)
        write_totals(totals, f"{at}/totals")
        write_counts(counts, f"{at}/counts")
        totals = spark.read.schema("n int, total long").json(f"{at}/totals")
        counts = spark.read.parquet(f"{at}/counts").select("n", "ngram", "count")
    scored = scores(counts, totals, config.max_ngram_size)
    return MiningRun(tokens, names, totals, counts, scored, decode_ids(select_vocabulary(scored, config.quotas), names))


def run_to_file(spark: SparkSession, config: MiningConfig, root: str, out: str, clean_up: bool = False, save_vocabulary: bool = True) -> MiningRun:
    """Writes counts, totals and the vocabulary; clean_up deletes all but the vocabulary afterwards."""
    done = run(spark, config, root, out)
    at = config.output_path(out)
    if clean_up or save_vocabulary:
        done.vocabulary = Table(done.vocabulary, "vocabulary").df
    if save_vocabulary:
        write_vocabulary(done.vocabulary, f"{at}/vocabulary")
    if clean_up:
        for folder in ("totals", "counts"):
            delete_folder(spark, f"{at}/{folder}")
    return done


def score_tokens(tokens: DataFrame, max_size: int, min_count: int = 1) -> DataFrame:
    """Association scores of pre-tokenised samples: no tokenizer, no quotas."""
    return scores(G.count_ngrams(tokens, list(range(1, max_size + 1)), min_count), G.totals(tokens, max_size), max_size)


def score_ids(tokens: DataFrame, max_size: int, min_count: int = 1) -> DataFrame:
    """The same for ids of a capped vocabulary."""
    return scores(G.count_id_ngrams(tokens, max_size, min_count), G.totals(tokens, max_size), max_size)
