"""lexibond: association mining over large text corpora, expressed as Spark DataFrame plans."""

from lexibond.config import MiningConfig

__all__ = ["MiningConfig"]
