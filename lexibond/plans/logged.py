"""A mining run that writes every stage and logs what the report operators read."""

from __future__ import annotations

import logging
import os
import platform
import shutil
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibond.config import MiningConfig
from lexibond.operators import ngrams as G
from lexibond.operators import scoring as S
from lexibond.operators.runlog import MODULE_PREFIX
from lexibond.operators.vocabulary import decode_ids, select_vocabulary
from lexibond.plans.mining import token_ids
from lexibond.sources import load_corpus
from lexibond.sources.sinks import delete_folder, run_logger, write_counts, write_totals, write_vocabulary


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Size of a folder on whatever file system holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def machine() -> dict[str, int]:
    """Cores, bytes of memory (in all and free) and of disk (in all and free) of the driver's machine."""
    page = os.sysconf("SC_PAGE_SIZE")
    disk = shutil.disk_usage(os.getcwd())
    cores = len(os.sched_getaffinity(0)) if hasattr(os, "sched_getaffinity") else os.cpu_count() or 1
    return {"cores": cores, "memory": page * os.sysconf("SC_PHYS_PAGES"), "memory_free": page * os.sysconf("SC_AVPHYS_PAGES"), "disk": disk.total, "disk_free": disk.free}


def executor_memory(spark: SparkSession) -> DataFrame:
    """executor, storage_bytes, storage_free_bytes: what each executor has for stored blocks."""
    found = spark._jsc.sc().getExecutorMemoryStatus()
    rows, at = [], found.iterator()
    while at.hasNext():
        one = at.next()
        rows.append((one._1(), int(one._2()._1()), int(one._2()._2())))
    return spark.createDataFrame(rows, "executor string, storage_bytes long, storage_free_bytes long")


def log_system(log: logging.Logger) -> None:
    """Operating system, processor, memory and disk of the driver."""
    has = machine()
    log.info("os: %s", platform.platform())
    log.info("processor: %s", platform.processor() or platform.machine())
    log.info("RAM_size: %d", has["memory"])
    log.info("memory: total: %d, used: %d, available: %d", has["memory"], has["memory"] - has["memory_free"], has["memory_free"])
    log.info("disk: total: %d, available: %d", has["disk"], has["disk_free"])


@contextmanager
def _step(name: str, log_file: str | None):
    log = run_logger(MODULE_PREFIX + name, log_file)
    log.info("start")
    yield log
    log.info("end")


def run_logged(spark: SparkSession, config: MiningConfig, root: str, out: str, log_file: str, clean_up: bool = False, save_vocabulary: bool = True) -> DataFrame:
    """Runs stage after stage, each a Parquet table under `out`; returns the vocabulary. An earlier run is replaced; clean_up
    deletes all tables but the vocabulary afterwards."""
    at = config.output_path(out)
    main = run_logger(MODULE_PREFIX + "run_pipeline", log_file)
    main.info("start experiment: %s", config.experiment_name)
    main.info("dataset: %s", config.dataset_name)
    main.info("n_workers: %d", spark.sparkContext.defaultParallelism)
    log_system(main)
    sizes = list(range(1, config.max_ngram_size + 1))

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{at}/{name}")
        return spark.read.parquet(f"{at}/{name}")

    tokens, names = token_ids(load_corpus(spark, config.dataset_name, root, config.n_samples), config.tokenizer_name)
    last_sample = tokens.count() - 1
    with _step("count_ngrams_in_batches", log_file) as log:
        write_totals(G.totals(tokens, config.max_ngram_size), f"{at}/totals")
        totals = spark.read.schema("n int, total long").json(f"{at}/totals")
        log.info("n_tokens: %d", totals.where("n = 1").first()["total"])
        write_counts(G.batch_counts(tokens, sizes, config.batch_size, config.min_count_batch_threshold), f"{at}/batches")
        for n in sizes:
            if spark.read.parquet(f"{at}/batches").where(F.col("n") == n).isEmpty():
                continue
            log.info("samples 0-%d, ngram size %d, parquet file size: %d", max(last_sample, 0), n, folder_bytes(spark, f"{at}/batches/n={n}"))
    with _step("aggregate_ngram_counts", log_file):
        counts = keep(G.sum_batches(spark.read.parquet(f"{at}/batches")), "summed")
    main.info("db size bytes after aggregate counts: %d", folder_bytes(spark, f"{at}/summed"))
    with _step("prune_low_count_ngrams", log_file):
        counts = keep(G.prune(counts, config.min_count_threshold), "pruned")
    with _step("compute_log_likelihood", log_file):
        scored = keep(S.with_log_likelihood(counts, totals), "likelihood")
    with _step("compute_max_segmentation_log_likelihood_sum", log_file):
        scored = keep(S.max_segmentation(scored, config.max_ngram_size), "segmented")
    with _step("compute_pmi_score", log_file):
        scored = keep(S.with_pmi(scored), "scored")
    main.info("db size bytes after pmi compute: %d", folder_bytes(spark, f"{at}/scored"))
    with _step("select_vocabulary", log_file):
        vocabulary = keep(decode_ids(select_vocabulary(scored, config.quotas), names), "selected")
    if save_vocabulary:
        write_vocabulary(vocabulary, f"{at}/vocabulary")
    if clean_up:
        for folder in ("totals", "batches", "summed", "pruned", "likelihood", "segmented", "scored"):
            delete_folder(spark, f"{at}/{folder}")
    main.info("end experiment: %s", config.experiment_name)
    return vocabulary
