"""Frame-level operators: keyed joins, reindexing, dedupe, set operations,
column selection and alignment, profiles and summary statistics."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import ensure_checkpoint_dir
from .ranks import order_stats


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used where several fits (medians, edges, categories) read the same
    expensive frame: the lineage is cut once and survives executor loss.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


# ------------------------------------------------------------------- joins

def semi(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other`` (``isin``)."""
    return df.join(other.select(key), key, "left_semi")


def anti(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other`` (null-safe, unlike NOT IN)."""
    return df.join(other.select(key), key, "left_anti")


def reindex_to_ids(ids: DataFrame, table: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Exactly the requested ids, in their order (``pos``), nulls where absent.

    Raises when ``table`` holds one of its keys twice (:func:`assert_unique`).
    """
    assert_unique(table, key)
    return ids.select(key, pos).join(table, key, "left").orderBy(pos)


def assert_unique(df: DataFrame, key: str) -> None:
    """Raise if a key occurs twice (one aggregate, returns at most one row)."""
    dup = df.groupBy(key).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate {key}: {dup[0][key]!r}")


def agreement_rate(a: DataFrame, b: DataFrame, key: str, col: str, col_b: str | None = None) -> DataFrame:
    """Share of keyed rows where ``a.col`` equals ``b.col`` (null-safe equality)."""
    col_b = col_b or col
    j = a.select(key, F.col(col).alias("_a")).join(b.select(key, F.col(col_b).alias("_b")), key)
    return j.agg(F.avg(F.col("_a").eqNullSafe(F.col("_b")).cast("double")).alias("agreement"),
                 F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- dedupe/sets

def dedupe_rows(df: DataFrame) -> DataFrame:
    """Drop full-row duplicates (all copies are equal, so which one stays is immaterial)."""
    return df.dropDuplicates()


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """Bind rows by column name; a column missing from a part is null there."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_values(df: DataFrame, cols: Sequence[str], name: str = "value") -> DataFrame:
    """Distinct non-null values found in any of ``cols`` (e.g. adep and ades)."""
    parts = [df.select(F.col(c).alias(name)) for c in cols]
    return functools.reduce(DataFrame.union, parts).where(F.col(name).isNotNull()).distinct()


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def set_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


# ------------------------------------------------------------ column shape

def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def target_last(df: DataFrame, target: str = "tow") -> DataFrame:
    return df.select(*[c for c in df.columns if c != target], target)


def align_columns(df: DataFrame, columns: Sequence[str], fill=0) -> DataFrame:
    """Exactly ``columns`` in that order: missing ones are ``fill``, extra ones dropped."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in columns])


def any_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    cond = functools.reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return df.where(cond)


def with_split_label(first: DataFrame, rest: DataFrame, label: str = "split",
                     names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Concatenate two frames with a label column (instead of positional slicing)."""
    return union_by_name(first.withColumn(label, F.lit(names[0])),
                         rest.withColumn(label, F.lit(names[1])))


def sort_by_custom_order(df: DataFrame, col: str, order: Sequence[str], out: str = "_order") -> DataFrame:
    """Add the position of ``col`` in the fixed ``order`` (1-based, null if absent)."""
    return df.withColumn(out, F.array_position(F.array(*[F.lit(x) for x in order]), F.col(col)).cast("int"))


def first_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int,
                      out: str = "n") -> DataFrame:
    """The first ``n`` rows of each group (window limit; partial limit runs map-side)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def topk(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows by ``order`` (TakeOrderedAndProject: per-task top-k, then merge)."""
    return df.orderBy(*order).limit(k)


# ---------------------------------------------------------------- profiles

def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, percentage) for columns with at least one null, most missing first.

    One pass: conditional counts, then an unpivot of the single result row.
    """
    cols = list(cols or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(f"m{i}") for i, c in enumerate(cols)])
    stack = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"))
                               for i, c in enumerate(cols)]))
    long = agg.select("_n", stack).where(F.col("missing") > 0)
    return (long.select("column", F.col("missing").cast("long").alias("missing"),
                        (F.col("missing") / F.col("_n") * 100).alias("percentage"))
                .orderBy(F.desc("missing"), "column"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col)


def nunique(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values per column as (column, nunique) rows."""
    if approx:
        row = df.agg(*[F.approx_count_distinct(F.col(c)).alias(f"u{i}") for i, c in enumerate(cols)])
        return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"u{i}").alias("nunique"))
                                             for i, c in enumerate(cols)])))
    # (column, value) pairs are made distinct before the shuffle; a null value stands for "no value" and is not counted
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])))
    return pairs.distinct().groupBy("column").agg(F.count("v").alias("nunique"))


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std (sample), min, 25%, 50%, 75%, max per numeric column, exact.

    One aggregate pass plus one distributed sort for all quartiles; the two
    single-row results are assembled on the driver (one row per column).
    """
    cols = list(cols or numeric_columns(df))
    basic = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(c).alias(f"n{i}"), F.avg(c).alias(f"a{i}"), F.stddev_samp(c).alias(f"s{i}"),
        F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}"))]).first()
    q = order_stats(df, [], {c: c for c in cols},
                    quantiles={f"{c}__{p}": (c, p / 100) for c in cols for p in (25, 50, 75)}).first()
    rows = [(c, basic[f"n{i}"], basic[f"a{i}"], basic[f"s{i}"], basic[f"lo{i}"],
             q[f"{c}__25"] if q else None, q[f"{c}__50"] if q else None, q[f"{c}__75"] if q else None,
             basic[f"hi{i}"]) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "column string, count long, mean double, std double, min double, q25 double, "
              "q50 double, q75 double, max double")


def boxplot_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Five-number summary with 1.5 IQR whiskers and outlier counts per column.

    Quartiles come from one distributed sort, whiskers and outliers from one
    aggregate pass over all columns.
    """
    cols = list(cols)
    q = order_stats(df, [], {c: c for c in cols},
                    quantiles={f"{c}__{p}": (c, p / 100) for c in cols for p in (25, 50, 75)}).first()
    fences, aggs = {}, []
    for i, c in enumerate(cols):
        q1, q3 = q[f"{c}__25"], q[f"{c}__75"]
        if q1 is None:
            continue
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        fences[c] = (i, lo, hi)
        x = F.col(c).cast("double")
        aggs += [F.min(F.when(x >= lo, x)).alias(f"wl{i}"), F.max(F.when(x <= hi, x)).alias(f"wh{i}"),
                 F.sum(((x < lo) | (x > hi)).cast("long")).alias(f"o{i}")]
    w = df.agg(*aggs).first() if aggs else None
    rows = [(c, q[f"{c}__25"], q[f"{c}__50"], q[f"{c}__75"], q[f"{c}__75"] - q[f"{c}__25"],
             w[f"wl{i}"], w[f"wh{i}"], w[f"o{i}"]) for c, (i, _, _) in fences.items()]
    return df.sparkSession.createDataFrame(
        rows, "column string, q1 double, median double, q3 double, iqr double, whisker_low double, "
              "whisker_high double, outliers long")


def histogram_edges(df: DataFrame, col: str, edges: Sequence[float]) -> DataFrame:
    """(bin, low, high, count) over given ascending edges; bins are open to the right but for the last, values outside
    are not counted. Gives the histograms of two sets the same bins."""
    x = F.col(col).cast("double")
    above = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x)) - 1
    counts = (df.where(x.between(float(edges[0]), float(edges[-1])))
                .groupBy(F.least(above, F.lit(len(edges) - 2)).alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    grid = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))],
                                           "bin int, low double, high double")
    return grid.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def histogram(df: DataFrame, col: str, bins: int = 200, density: bool = False) -> DataFrame:
    """Equal-width bins between min and max; the last bin includes the maximum.

    (bin, low, high, count[, density]) for every bin, empty bins included.
    """
    spark = df.sparkSession
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()
    lo, hi, n = rng["lo"], rng["hi"], rng["n"]
    if lo is None:
        return spark.createDataFrame([], "bin int, low double, high double, count long")
    width = (hi - lo) / bins if hi > lo else 1.0
    idx = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = (grid.join(F.broadcast(counts), "bin", "left")
               .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"),
                       (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
                       F.coalesce("count", F.lit(0)).cast("long").alias("count")))
    if density:
        out = out.withColumn("density", F.col("count") / F.lit(float(n) * width))
    return out


# ------------------------------------------------------------- correlation

def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r for every ordered pair (a, b), pairwise-complete rows, one pass."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}")
                   for k, (a, b) in enumerate(pairs)])
    structs = []
    for k, (a, b) in enumerate(pairs):
        structs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")))
        structs.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"r{k}").alias("r")))
    for c in cols:
        structs.append(F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("r")))
    return row.select(F.inline(F.array(*structs)))


def correlated_drop(corr: DataFrame, cols: Sequence[str], threshold: float = 0.98) -> DataFrame:
    """Columns to drop: b of every upper-triangle pair (a before b) with |r| > threshold."""
    pos = {c: i for i, c in enumerate(cols)}
    order = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])
    return (corr.where((order[F.col("a")] < order[F.col("b")]) & (F.abs("r") > threshold))
                .select(F.col("b").alias("column")).distinct())
