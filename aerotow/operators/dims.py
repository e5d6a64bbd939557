"""Dimension joins: bounded broadcast, priority dedupe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def broadcast_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast only if it has at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows.  Beyond the bound the join
    is left to the planner (sort-merge or AQE's runtime broadcast).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def dedupe_key_first(df: DataFrame, key, order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order`` (e.g. source rank, line number).

    Not ``dropDuplicates([key])``, which keeps an arbitrary row.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
