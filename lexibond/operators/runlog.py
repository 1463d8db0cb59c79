"""Analytics over run logs: parsing, pairing of starts and ends, step times, the report and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexibond.functions.units import STEP_GROWTH, duration_text, grow_linear, grow_n_log_n, grow_step, size_text

# The layout of a log line and the messages that carry a run's figures.
LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),\d+ - ([\w.]+) - (\w+) - (.*)$"
MODULE_PREFIX = "lexibond.run."  # before step names; logs of other writers have their own
MESSAGES = {
    "n_tokens": r"n_tokens: (\d+)",
    "n_workers": r"n_workers: (\d+)",
    "RAM_size": r"RAM_size: (\d+)",
    "os": r"os: (.*)",
    "processor": r"processor: (.*)",
    "dataset_name": r"dataset: (.*)",
    "db_size_after_aggregate": r"db size bytes after aggregate counts: (\d+)",
    "db_size_after_pmi": r"db size bytes after pmi compute: (\d+)",
}
BATCH_FILE = r"samples \d+-\d+, ngram size \d+, parquet file size: (\d+)"
NUMBERS = ("n_tokens", "n_workers", "RAM_size", "db_size_after_aggregate", "db_size_after_pmi")


def parse_log(lines: DataFrame) -> DataFrame:
    """line_no, ts, module_name, level, message; lines of another layout have parsed = false and nulls."""
    ok = F.col("line").rlike(LINE)
    part = lambda i: F.when(ok, F.regexp_extract("line", LINE, i))
    return lines.select("line_no", part(1).cast("timestamp").alias("ts"), part(2).alias("module_name"), part(3).alias("level"), part(4).alias("message"), F.coalesce(ok, F.lit(False)).alias("parsed"))


def matching(parsed: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """Lines whose whole message fits the pattern, with the group's text as `value`."""
    whole = f"^(?:{pattern})$"
    return parsed.where(F.col("message").rlike(whole)).withColumn("value", F.regexp_extract("message", whole, group))


def pair_starts_ends(parsed: DataFrame, is_start: Column, is_end: Column, by: list[str] | None = None) -> DataFrame:
    """Each end line with the latest start line before it (as-of): start_line, end_line, start_ts, end_ts, seconds.

    Starts that were never ended drop out; an end without a start has nulls. `by` pairs within groups; without it all start
    and end lines (not the log) are one window, which suits the few of an experiment."""
    before = Window.partitionBy(*(by or [])).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    marked = parsed.where(is_start | is_end).withColumn("s", F.last(F.when(is_start, F.struct("line_no", "ts")), ignorenulls=True).over(before))
    ends = marked.where(is_end)
    return ends.select(*(by or []), F.col("s.line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.col("s.ts").alias("start_ts"), F.col("ts").alias("end_ts"), seconds_between(F.col("s.ts"), F.col("ts")).alias("seconds"))


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds; a run of more than a day isn't wrapped."""
    return F.unix_timestamp(b) - F.unix_timestamp(a)


def last_run(parsed: DataFrame, experiment: str) -> DataFrame:
    """The lines of an experiment's last finished run, start and end included. Only its few start and end lines are paired."""
    pairs = pair_starts_ends(parsed, F.col("message") == f"start experiment: {experiment}", F.col("message") == f"end experiment: {experiment}")
    span = pairs.agg(F.max(F.struct("end_line", "start_line")).alias("m")).select(F.col("m.start_line").alias("from_line"), F.col("m.end_line").alias("to_line"))
    return parsed.join(F.broadcast(span), F.col("line_no").between(F.col("from_line"), F.col("to_line"))).drop("from_line", "to_line")


def step_times(run: DataFrame, prefix: str = MODULE_PREFIX) -> DataFrame:
    """step, pairs, seconds for the steps of a run; pairs other than 1 mean a damaged log."""
    step = F.expr(f"substring(module_name, {len(prefix) + 1})")
    known = run.withColumn("step", step).where(F.col("step").isin(list(STEP_GROWTH)) & F.col("module_name").startswith(prefix))
    pairs = pair_starts_ends(known, F.col("message") == "start", F.col("message") == "end", ["step"])
    return pairs.groupBy("step").agg(F.count(F.lit(1)).alias("pairs"), F.max("seconds").alias("seconds"))


def run_facts(run: DataFrame) -> DataFrame:
    """One row: each figure, total_time, batch_files_total_size, total_space, and `complete`: each figure found once."""
    value = lambda p: F.when(F.col("message").rlike(f"^(?:{p})$"), F.regexp_extract("message", f"^(?:{p})$", 1))
    kind = lambda k: "long" if k in NUMBERS else "string"
    agg = [F.max(value(p)).cast(kind(k)).alias(k) for k, p in MESSAGES.items()]
    once = [F.count(value(p)).alias(f"_{k}") for k, p in MESSAGES.items()]
    row = run.agg(*agg, *once, F.sum(value(BATCH_FILE).cast("long")).alias("batch_files_total_size"), seconds_between(F.min("ts"), F.max("ts")).alias("total_time"))
    complete = F.col("batch_files_total_size").isNotNull()
    for k in MESSAGES:
        complete = complete & (F.col(f"_{k}") == 1)
    return row.withColumn("total_space", F.greatest("db_size_after_pmi", "db_size_after_aggregate", "batch_files_total_size")).withColumn("complete", complete).drop(*[f"_{k}" for k in MESSAGES])


def experiment_information(parsed: DataFrame, experiment: str) -> DataFrame:
    """run_facts with compute_steps_times, a map of step to seconds."""
    run = last_run(parsed, experiment)
    steps = step_times(run).agg(F.map_from_entries(F.collect_list(F.struct("step", F.col("seconds").cast("double")))).alias("compute_steps_times"))
    return run_facts(run).join(F.broadcast(steps))


def report_row(facts: DataFrame) -> DataFrame:
    """report: the figures as one row of a Markdown table."""
    cells = [F.col("dataset_name"), F.format_number("n_tokens", 0), F.col("processor"), F.col("n_workers").cast("string"), size_text(F.col("RAM_size").cast("double")), F.col("os"), duration_text(F.col("total_time").cast("double")), size_text(F.col("total_space").cast("double"))]
    return facts.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("report"))


def estimates(facts: DataFrame, steps: DataFrame, target_tokens: int, workers: int | None = None) -> DataFrame:
    """One row: space and the two time estimates for a corpus of target_tokens, with `workers` in place of the run's."""
    target = F.lit(float(target_tokens))
    had = F.col("n_tokens").cast("double")
    factor = F.lit(1.0) if workers is None else F.col("n_workers") / F.lit(float(workers))
    per_step = steps.select("step", F.col("seconds").cast("double").alias("seconds")).crossJoin(F.broadcast(facts.select("n_tokens", "n_workers")))
    summed = per_step.agg(F.sum(factor * grow_step(F.col("step"), had, target, F.col("seconds"))).alias("time_by_steps"))
    one = facts.select(grow_linear(had, target, F.col("total_space").cast("double")).alias("space"), (factor * grow_n_log_n(had, target, F.col("total_time").cast("double"))).alias("time_n_log_n"))
    return one.join(F.broadcast(summed))
