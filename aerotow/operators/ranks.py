"""Exact order statistics without collecting a group into one task.

``value_ranges`` turns the non-null values of each group into distinct
(group, value, count) rows and gives each the range of ranks it covers
(``_start`` < rank <= ``_start + _c``) plus the group size ``_n``:

1. ``groupBy(keys, value).count()`` -- partial aggregation collapses ties, so
   a hot group of one repeated value is a single row after the map side;
2. the distinct pairs (no ties left) are range-partitioned on
   (keys, value) into ``P`` partitions, so a group holding a third of all rows
   is spread over about a third of the partitions; the partition id is
   materialised once by a reliable checkpoint (shared folder named by
   ``spark.checkpoint.dir``) so every later branch sees the same assignment
   and the frame survives executor loss;
3. counts per (partition, group) -- at most ``#groups + P`` rows -- give the
   offset of each slice; a window on (partition, group) gives the local
   prefix; both are joined on (partition, group), whose hash spreads a hot
   group over many tasks.

Trimmed means, exact quantiles and medians are then plain filtered
aggregates (partial aggregation before the shuffle).  Exact ``percentile``
would instead keep a value->count map for the whole group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def value_ranges(df: DataFrame, keys: Sequence[str], value: str,
                 partitions: int | None = None) -> DataFrame:
    """(keys, value, _c, _start, _n): rank range of every distinct value per group."""
    keys = list(keys)
    p = _partitions(df, partitions)
    ensure_checkpoint_dir(df.sparkSession)
    h = (df.select(*keys, value).where(F.col(value).isNotNull())
           .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))
    hs = (h.repartitionByRange(p, *keys, value)
           .withColumn("_pid", F.spark_partition_id())
           .checkpoint(eager=True))
    cnt = hs.groupBy("_pid", *keys).agg(F.sum("_c").alias("_pc"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # The offset windows run over the small (partition, group) count table.
    cnt = cnt.select("_pid", *keys, F.coalesce(F.sum("_pc").over(before), F.lit(0)).alias("_off"),
                     F.sum("_pc").over(Window.partitionBy(*keys)).alias("_n"))
    local = Window.partitionBy("_pid", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    hs = hs.withColumn("_ls", F.coalesce(F.sum("_c").over(local), F.lit(0)))
    out = hs.join(cnt, ["_pid", *keys])
    return out.select(*keys, value, F.col("_c").cast("long").alias("_c"),
                      (F.col("_off") + F.col("_ls")).cast("long").alias("_start"),
                      F.col("_n").cast("long").alias("_n"))


def rank_within(df: DataFrame, keys: Sequence[str], value: str,
                partitions: int | None = None) -> DataFrame:
    """Rows of ``(keys, value)`` with ``_rank`` (1-based, ascending) and ``_n``.

    One row per non-null input value (ties get consecutive ranks); built on
    :func:`value_ranges`, so the work per task stays bounded.
    """
    r = value_ranges(df, keys, value, partitions)
    # ties in two steps, so that no row's array is longer than 2^16 elements (2^32 ties of one value)
    step = F.lit(1 << 16).cast("long")
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / step))
    r = r.withColumn("_b", F.explode(blocks))
    last = F.least(F.col("_c"), (F.col("_b") + 1) * step)
    return (r.withColumn("_k", F.explode(F.sequence(F.col("_b") * step + 1, last)))
             .select(*keys, value, (F.col("_start") + F.col("_k")).alias("_rank"), "_n"))


def rank_within_window(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Same output as :func:`rank_within`, computed with a window per group.

    Cheaper (no extra shuffle when the input is already partitioned by a
    subset of ``keys``) but a group is processed by a single task; used for
    per-flight groups whose size is bounded by the flight duration.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(value)
    return (df.select(*keys, value).where(F.col(value).isNotNull())
              .withColumn("_rank", F.row_number().over(w).cast("long"))
              .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))))


def stack(df: DataFrame, keys: Sequence[str], measures: dict[str, Column | str],
          name: str = "_measure", value: str = "_value") -> DataFrame:
    """Unpivot ``measures`` into (keys, name, value) rows, nulls dropped."""
    arr = F.array(*[F.struct(F.lit(m).alias(name), (F.col(c) if isinstance(c, str) else c)
                             .cast("double").alias(value))
                    for m, c in measures.items()])
    return (df.select(*keys, F.inline(arr))
              .where(F.col(value).isNotNull()))


def order_stats(df: DataFrame, keys: Sequence[str], measures: dict[str, Column | str],
                trims: dict[str, float] | None = None,
                quantiles: dict[str, tuple[str, float]] | None = None,
                partitions: int | None = None, method: str = "sort") -> DataFrame:
    """Trimmed means and exact (linear) quantiles of several measures at once.

    ``trims``: output column -> trim fraction for the measure of the same name
    (R ``mean(x, trim=)``: drop floor(n * trim) values at each end).
    ``quantiles``: output column -> (measure, q), type-7 interpolation.
    One distributed sort serves all measures (``method="window"`` ranks with
    a window per group instead, see :func:`rank_within_window`).  Returns one row per key group
    that has at least one non-null value in some measure.
    """
    keys = list(keys)
    trims = trims or {}
    quantiles = quantiles or {}
    long = stack(df, keys, measures)
    gk = keys + ["_measure"]
    if method == "window":
        r = rank_within_window(long, gk, "_value").withColumn("_c", F.lit(1)) \
            .withColumn("_start", F.col("_rank") - 1)
    else:
        r = value_ranges(long, gk, "_value", partitions)
    m, v, n = F.col("_measure"), F.col("_value"), F.col("_n")
    lo_r, hi_r = F.col("_start") + 1, F.col("_start") + F.col("_c")   # ranks covered by the row
    aggs = []
    for out, trim in trims.items():
        k = F.floor(n * F.lit(trim))
        overlap = F.greatest(F.least(hi_r, n - k) - F.greatest(lo_r - 1, k), F.lit(0))
        w = F.when(m == out, overlap)
        aggs.append(F.try_divide(F.sum(v * w), F.sum(w).cast("double")).alias(out))
    for out, (meas, q) in quantiles.items():
        h = (n - 1).cast("double") * F.lit(q)
        lo, hi = F.floor(h) + 1, F.ceil(h) + 1
        sel = m == meas
        aggs.append(F.max(F.when(sel & (lo_r <= lo) & (hi_r >= lo), v)).alias(f"{out}__lo"))
        aggs.append(F.max(F.when(sel & (lo_r <= hi) & (hi_r >= hi), v)).alias(f"{out}__hi"))
        aggs.append(F.max(F.when(sel, h - F.floor(h))).alias(f"{out}__d"))
    res = r.groupBy(*keys).agg(*aggs) if keys else r.agg(*aggs)
    between = [_between(F.col(f"{out}__lo"), F.col(f"{out}__hi"), F.col(f"{out}__d")).alias(out) for out in quantiles]
    return res.select(*keys, *trims, *between)


def _between(lo: Column, hi: Column, d: Column) -> Column:
    return lo + (hi - lo) * d


def quantiles(df: DataFrame, cols: Sequence[str], q: float = 0.5,
              keys: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Exact type-7 quantile of each column (per key group if ``keys``)."""
    return order_stats(df, keys, {c: c for c in cols},
                       quantiles={c: (c, q) for c in cols}, partitions=partitions)


def medians(df: DataFrame, cols: Sequence[str], partitions: int | None = None) -> dict[str, float]:
    """Exact medians of many columns with a single sort; returns scalars.

    The driver receives one value per column.
    """
    cols = list(dict.fromkeys(cols))
    if not cols:
        return {}
    # a row per column, not three aggregates: the plan is as large for a thousand columns as for one
    long = (df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("_measure", "_value"))
              .where(F.col("_value").isNotNull()))
    r = value_ranges(long, ["_measure"], "_value", partitions)
    h = (F.col("_n") - 1).cast("double") * F.lit(0.5)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") + 1 <= rank) & (F.col("_start") + F.col("_c") >= rank), F.col("_value")))
    rows = (r.groupBy("_measure").agg(at(F.floor(h) + 1).alias("lo"), at(F.ceil(h) + 1).alias("hi"), F.max(h - F.floor(h)).alias("d"))
             .select("_measure", _between(F.col("lo"), F.col("hi"), F.col("d")).alias("m")).collect())
    found = {x["_measure"]: x["m"] for x in rows}
    return {c: found.get(i) for i, c in enumerate(cols)}
