"""Readable durations and sizes, and extrapolation from one corpus size to another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Steps of a run with the growth and the safety factor of each.
STEP_GROWTH = {
    "count_ngrams_in_batches": ("linear", 1.0),
    "aggregate_ngram_counts": ("n_log_n", 1.5),
    "prune_low_count_ngrams": ("n_log_n", 1.25),
    "compute_log_likelihood": ("linear", 1.25),
    "compute_max_segmentation_log_likelihood_sum": ("n_log_n", 2.0),
    "compute_pmi_score": ("linear", 4.0),
    "select_vocabulary": ("n_log_n", 2.0),
}
CORPUS_TOKENS = {"bookcorpus": 1_098_720_840, "wikipedia": 24_000_000_000, "RedPajama": 1_200_000_000_000}


def two_places(x: Column) -> Column:
    """A number of 0 or more with two decimals, rounded from its exact binary value (ties to even), as C's %.2f does.

    Java's formatter rounds the shortest decimal instead, which differs at ties such as 1.005."""
    whole = F.floor(x)
    scaled = ((x - whole) * 2.0**52).cast("long") * 100
    cents, rest, half = F.shiftright(scaled, 52), scaled % 2**52, 2**51
    cents = cents + F.when((rest > half) | ((rest == half) & (cents % 2 == 1)), 1).otherwise(0)
    return F.concat((whole + F.floor(cents / 100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def duration_text(seconds: Column) -> Column:
    out = F.concat(two_places(seconds / 60 / 60 / 24), F.lit(" days"))
    for value, below, unit in ((seconds / 60 / 60, 50, "hours"), (seconds / 60, 120, "minutes"), (seconds, 120, "seconds")):
        out = F.when(value < below, F.concat(two_places(value), F.lit(f" {unit}"))).otherwise(out)
    return out


def size_text(size: Column) -> Column:
    out = F.concat(two_places(size / 1024.0**4), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "Bytes")):
        value = size / 1024.0**power
        out = F.when(value < 1024, F.concat(two_places(value), F.lit(f" {unit}"))).otherwise(out)
    return out


def grow_linear(small: Column, large: Column, value: Column) -> Column:
    return large / small * value


def grow_n_log_n(small: Column, large: Column, value: Column) -> Column:
    return (large * F.log2(large)) / (small * F.log2(small)) * value


def grow_times_sqrt(small: Column, large: Column, value: Column) -> Column:
    return F.pow(large, F.lit(1.5)) / F.pow(small, F.lit(1.5)) * value


GROWTH = {"linear": grow_linear, "n_log_n": grow_n_log_n, "times_sqrt": grow_times_sqrt}


def grow_step(step: Column, small: Column, large: Column, value: Column) -> Column:
    """The estimate for one named step; null for an unknown step."""
    out = F.lit(None).cast("double")
    for name, (kind, factor) in STEP_GROWTH.items():
        out = F.when(step == name, F.lit(factor) * GROWTH[kind](small, large, value)).otherwise(out)
    return out
