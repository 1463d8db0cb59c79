"""Validated settings of a mining run and the paths derived from them."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field
from math import floor


def size_quotas(percent: dict[int, float], vocab_size: int) -> dict[int, int]:
    """How many n-grams of each size the vocabulary holds: floors, and what floors leave over goes to size 2."""
    quota = {n: floor(vocab_size * p / 100) for n, p in percent.items()}
    quota[2] = quota.get(2, 0) + vocab_size - sum(quota.values())
    return quota


@dataclass(frozen=True)
class MiningConfig:
    """One mining run. Bad combinations raise ValueError when the object is made."""

    experiment_name: str
    dataset_name: str
    tokenizer_name: str = "word-level"
    max_ngram_size: int = 5
    min_count_threshold: int = 10
    vocab_size: int = 800_000
    percents: tuple[float, ...] = field(default=(50.0, 25.0, 12.5, 12.5))
    batch_size: int = 250_000
    min_count_batch_threshold: int = 1
    n_samples: int | None = None

    def __post_init__(self) -> None:
        for name, least in (("max_ngram_size", 2), ("min_count_threshold", 1), ("vocab_size", 1), ("batch_size", 1), ("min_count_batch_threshold", 1)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")
        if self.n_samples is not None and self.n_samples < 1:
            raise ValueError("n_samples must be at least 1")
        if not self.experiment_name:
            raise ValueError("experiment_name is required")
        if any(p <= 0 for p in self.percents):
            raise ValueError("every percent must be above 0")
        if len(self.percents) != self.max_ngram_size - 1:
            raise ValueError("there must be one percent for each n-gram size from 2 up")
        if sum(self.percents) != 100:
            raise ValueError("the percents must sum to 100")
        if self.min_count_threshold <= self.min_count_batch_threshold:
            raise ValueError("min_count_threshold must be above min_count_batch_threshold")

    @property
    def quotas(self) -> dict[int, int]:
        return size_quotas(dict(enumerate(self.percents, start=2)), self.vocab_size)

    def output_path(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.experiment_name}"


def at_least(least: int):
    """An argparse type: an integer not below `least`."""

    def parse(text: str) -> int:
        try:
            value = int(text)
        except ValueError as e:
            raise argparse.ArgumentTypeError(f"{text!r} is not an integer") from e
        if value < least:
            raise argparse.ArgumentTypeError(f"{value} is below {least}")
        return value

    return parse


def above_zero(text: str) -> float:
    """An argparse type: a number above 0."""
    try:
        value = float(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(f"{text!r} is not a number") from e
    if value <= 0:
        raise argparse.ArgumentTypeError(f"{value} isn't above 0")
    return value
