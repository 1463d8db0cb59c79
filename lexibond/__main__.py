"""python -m lexibond --experiment_name x --dataset_name documents --root DIR --out DIR"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from lexibond.config import MiningConfig, above_zero, at_least
from lexibond.functions.text import load_word_pieces, register_tokenizer, tokenizer_names, word_piece_spec
from lexibond.plans.logged import run_logged
from lexibond.plans.mining import run_to_file
from lexibond.sources import corpus_names


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexibond")
    p.add_argument("--experiment_name", required=True)
    p.add_argument("--dataset_name", required=True, choices=corpus_names())
    p.add_argument("--tokenizer_name", choices=[*tokenizer_names(), "word-piece"], default=tokenizer_names()[0])
    p.add_argument("--vocab_file", help="pieces, one a line, for the word-piece tokenizer")
    p.add_argument("--max_ngram_size", type=at_least(2), default=5)
    p.add_argument("--min_count_threshold", type=at_least(1), default=10)
    p.add_argument("--vocab_size", type=at_least(1), default=800_000)
    p.add_argument("--ngram_size_to_vocab_percent", type=above_zero, nargs="+", default=[50, 25, 12.5, 12.5])
    p.add_argument("--ngram_count_batch_size", type=at_least(1), default=250_000)
    p.add_argument("--min_count_batch_threshold", type=at_least(1), default=1)
    p.add_argument("--n_workers", type=at_least(1), help="cores, where no Spark master is set")
    p.add_argument("--tokenizer_batch_size", type=at_least(1), default=100_000, help="rows of an Arrow batch")
    p.add_argument("--log", help="log file of the run, for lexibond.report")
    p.add_argument("--clean_up", action="store_true", help="delete the tables of the run, but for the vocabulary")
    p.add_argument("--no_vocabulary_file", action="store_true", help="don't write the vocabulary")
    p.add_argument("--n_samples", type=at_least(1))
    p.add_argument("--root", required=True, help="folder of the Parquet tables")
    p.add_argument("--out", required=True, help="folder for counts, totals and the vocabulary")
    return p


def config_of(args: argparse.Namespace) -> MiningConfig:
    return MiningConfig(args.experiment_name, args.dataset_name, args.tokenizer_name, args.max_ngram_size, args.min_count_threshold, args.vocab_size, tuple(args.ngram_size_to_vocab_percent), args.ngram_count_batch_size, args.min_count_batch_threshold, args.n_samples)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    try:
        if args.tokenizer_name == "word-piece" and not args.vocab_file:
            raise ValueError("the word-piece tokenizer needs --vocab_file")
        config = config_of(args)
    except ValueError as e:
        parser().error(str(e))
    builder = SparkSession.builder.appName("lexibond").config("spark.sql.execution.arrow.maxRecordsPerBatch", args.tokenizer_batch_size)
    if args.n_workers and "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{args.n_workers}]")
    spark = builder.getOrCreate()
    if args.tokenizer_name == "word-piece":
        register_tokenizer(word_piece_spec(load_word_pieces(spark, args.vocab_file)))
    if args.log:
        run_logged(spark, config, args.root, args.out, args.log, args.clean_up, not args.no_vocabulary_file)
    else:
        run_to_file(spark, config, args.root, args.out, args.clean_up, not args.no_vocabulary_file)


if __name__ == "__main__":
    main()
