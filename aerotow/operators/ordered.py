"""Whole-table ordered operators without a single-partition window.

An expanding mean, a forward fill or a row number "over the whole table in row order" is a prefix computation. Written
as a window with an empty partition spec it would pull every row into one task. Instead:

1. the rows are range-partitioned by the order key (any sortable columns) into blocks of about ``BLOCK_ROWS`` rows,
   whatever the session's shuffle partitions, and written in buckets of the block, so that every later step agrees on a
   row's block and reads it without a shuffle;
2. a window per block does the local prefix work;
3. one summary row per block gives each block its carry from the blocks before. The summaries are scanned in two levels
   (within groups of ``GROUP`` blocks, then over the groups), and broadcast: they are as many as there are buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import MAX_BUCKETS, bucketed
from .ranks import _partitions

#: Rows of a block, and blocks of a group.
BLOCK_ROWS = 1_000_000
GROUP = 1_000


def _blocks(df: DataFrame, order: Sequence[str], partitions: int | None) -> DataFrame:
    """``df`` with the block ``_b`` of every row; blocks ascend with the order key."""
    p = min(MAX_BUCKETS, max(_partitions(df, partitions), -(-df.count() // BLOCK_ROWS)))
    ranged = df.repartitionByRange(p, *order).withColumn("_b", F.spark_partition_id())
    return bucketed(ranged, "_b", p, "ordered")


def _carried(blocks: DataFrame, columns: dict[str, Callable[[Column | str], Column]]) -> DataFrame:
    """(_b, columns) where each column is folded over all blocks before ``_b`` by its aggregate."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    g = blocks.withColumn("_g", F.floor(F.col("_b") / GROUP))
    inner = before(Window.partitionBy("_g").orderBy("_b"))
    # in order within the group, so that a last value is the last block's
    whole = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = g.select("_g", *(agg(c).over(whole).alias(c) for c, agg in columns.items())).distinct()
    outer = groups.select("_g", *(agg(c).over(before(Window.orderBy("_g"))).alias(f"{c}_out") for c, agg in columns.items()))
    inside = g.select("_b", "_g", *(agg(c).over(inner).alias(f"{c}_in") for c, agg in columns.items()))
    return inside.join(F.broadcast(outer), "_g").drop("_g")


def running_mean(df: DataFrame, value: str, order: Sequence[str], out: str,
                 partitions: int | None = None) -> DataFrame:
    """Expanding mean of ``value`` (nulls skipped) in ``order`` (must be unique)."""
    order = list(order)
    s = _blocks(df, order, partitions)
    tot = s.groupBy("_b").agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    zero = lambda c: F.coalesce(F.col(f"{c}_in"), F.lit(0)) + F.coalesce(F.col(f"{c}_out"), F.lit(0))
    carry = _carried(tot, {"_s": F.sum, "_c": F.sum}).select("_b", zero("_s").alias("_cs"), zero("_c").alias("_cc"))
    w = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("_ls", F.sum(value).over(w)).withColumn("_lc", F.count(value).over(w))
    s = s.join(F.broadcast(carry), "_b")
    mean = F.try_divide(F.coalesce(F.col("_ls"), F.lit(0.0)) + F.col("_cs"),
                        (F.col("_lc") + F.col("_cc")).cast("double"))
    return s.withColumn(out, mean).drop("_b", "_ls", "_lc", "_cs", "_cc")


def forward_fill(df: DataFrame, cols: Sequence[str], order: Sequence[str],
                 partitions: int | None = None) -> DataFrame:
    """Replace nulls by the last earlier non-null value in ``order`` (must be unique)."""
    order, cols = list(order), list(cols)
    s = _blocks(df, order, partitions)
    okey = F.struct(*order)
    last_in_block = s.groupBy("_b").agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(f"_l_{c}") for c in cols])
    last = lambda c: F.last(c, ignorenulls=True)
    carry = _carried(last_in_block, {f"_l_{c}": last for c in cols})
    w = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    s = s.join(F.broadcast(carry), "_b")
    s = s.withColumns({c: F.coalesce(F.col(c), F.col(f"_l_{c}_in"), F.col(f"_l_{c}_out")) for c in cols})
    return s.drop("_b", *[f"_l_{c}_{x}" for c in cols for x in ("in", "out")])


def numbered(df: DataFrame, order: Sequence[str], out: str = "_row", partitions: int | None = None) -> DataFrame:
    """``df`` with the place of every row, from 0, in ``order`` (must be unique)."""
    s = _blocks(df, list(order), partitions)
    sizes = s.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    carry = _carried(sizes, {"_n": F.sum}).select("_b", (F.coalesce("_n_in", F.lit(0)) + F.coalesce("_n_out", F.lit(0))).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return (s.withColumn("_in_block", place).join(F.broadcast(carry), "_b")
            .withColumn(out, F.col("_first") + F.col("_in_block")).drop("_b", "_in_block", "_first"))
