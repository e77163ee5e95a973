"""Bounded samples of labelled or hinted rows, by the hash of an id: the same rows however the input is partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_cut(key: Column, size: int, total: int | Column) -> Column:
    """Whether a row's hash is low enough that about ``2 * size`` of ``total`` rows pass; all do if there are no more."""
    share = F.least(F.lit(1.0), F.lit(2.0 * size) / F.greatest(F.lit(1), F.lit(total) if isinstance(total, int) else total))
    return (share >= 1.0) | (F.xxhash64(key).cast("double") / 2.0**64 + 0.5 < share)
