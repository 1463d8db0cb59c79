"""python -m lexibond.report --log FILE --experiment_name x [--target_tokens N [--workers W]], or --compare FILE FILE"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexibond.functions.units import duration_text, size_text
from lexibond.operators import runlog as L
from lexibond.operators.vocabulary import compare_vocabularies
from lexibond.sources import read_log_lines, read_vocabulary


def print_report(spark: SparkSession, log_path: str, experiment: str) -> None:
    """The figures of the last finished run and the row for a table of runs."""
    info = L.experiment_information(L.parse_log(read_log_lines(spark, log_path)), experiment)
    print(info.first().asDict())
    print(L.report_row(info).first()["report"])


def print_estimate(spark: SparkSession, log_path: str, experiment: str, target_tokens: int, workers: int | None) -> None:
    run = L.last_run(L.parse_log(read_log_lines(spark, log_path)), experiment)
    one = L.estimates(L.run_facts(run), L.step_times(run), target_tokens, workers)
    row = one.select(size_text(F.col("space")).alias("space"), duration_text(F.col("time_n_log_n")).alias("time_n_log_n"), duration_text(F.col("time_by_steps")).alias("time_by_steps"))
    print(row.first().asDict())


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lexibond.report")
    p.add_argument("--log")
    p.add_argument("--experiment_name")
    p.add_argument("--target_tokens", type=int)
    p.add_argument("--workers", type=int)
    p.add_argument("--compare", nargs=2, metavar="VOCABULARY")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("lexibond-report").getOrCreate()
    if args.compare:
        print(compare_vocabularies(*(read_vocabulary(spark, f) for f in args.compare)).first().asDict())
    elif args.target_tokens:
        print_estimate(spark, args.log, args.experiment_name, args.target_tokens, args.workers)
    else:
        print_report(spark, args.log, args.experiment_name)


if __name__ == "__main__":
    main()
