"""Writers: counts, totals, vocabulary and log."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession

from lexibond.operators.vocabulary import vocabulary_lines

# Fixed value: the layout that log readers expect.
LOG_FORMAT = "%(asctime)s - %(name)s - %(levelname)s - %(message)s"


def write_counts(counts: DataFrame, path: str) -> None:
    """A Parquet folder for each n; an earlier run's folder is replaced."""
    counts.write.mode("overwrite").partitionBy("n").parquet(path)


def write_totals(totals: DataFrame, path: str) -> None:
    totals.coalesce(1).write.mode("overwrite").json(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """One n-gram a line, sizes ascending and best first; Spark sorts by range, so files in name order are the list."""
    vocabulary_lines(vocab).write.mode("overwrite").text(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """On whatever file system holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class _Opened(logging.FileHandler):
    """A log file that this process writes, known by its path."""


def run_logger(name: str, path: str | None = None) -> logging.Logger:
    """Console log and, with a path, the same lines appended to that driver-side file, and to no other: a logger that wrote
    to another file before writes there no longer, and asking twice doesn't write lines twice."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    layout = logging.Formatter(LOG_FORMAT)
    for held in [h for h in log.handlers if isinstance(h, _Opened) and h.baseFilename != os.path.abspath(path or "")]:
        log.removeHandler(held)
        held.close()
    missing = [] if any(type(h) is logging.StreamHandler for h in log.handlers) else [logging.StreamHandler()]
    if path and not any(isinstance(h, _Opened) for h in log.handlers):
        missing.append(_Opened(path))
    for handler in missing:
        handler.setFormatter(layout)
        log.addHandler(handler)
    return log
