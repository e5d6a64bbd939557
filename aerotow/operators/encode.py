"""Imputation, encoding, scaling, splits and noise with fit/transform semantics.

Fitted state is small and lives on the driver: one scalar per column
(medians, means, standard deviations) or one sorted category list per column
(bounded by ``max_categories``, checked).  Transforms are column expressions.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from .ordered import numbered
from .ranks import medians as exact_medians
from .ranks import rank_within

MISSING = "MissingValue"


# --------------------------------------------------------------- imputation

def fit_medians(df: DataFrame, cols: Sequence[str], approx: bool = False,
                accuracy: int = 10000) -> dict[str, float]:
    """Median of each column over non-null values.

    Exact by default (one distributed sort for all columns); ``approx=True``
    uses ``percentile_approx`` (bounded memory, rank error ~ 1/accuracy).
    """
    cols = list(cols)
    if approx:
        row = df.agg(*[F.percentile_approx(c, 0.5, accuracy).alias(c) for c in cols]).first()
        return {c: row[c] for c in cols}
    return exact_medians(df, cols)


def fill(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Replace nulls of each column by its fitted value (columns without a value stay)."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
                           for c, v in values.items() if v is not None})


def impute_median(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                  approx: bool = False) -> tuple[DataFrame, dict[str, float]]:
    """Fill nulls with the median fitted on ``fit_on`` (default: ``df`` itself)."""
    m = fit_medians(fit_on if fit_on is not None else df, cols, approx)
    return fill(df, m), m


def impute_mean_train(df: DataFrame, cols: Sequence[str], train: Column) -> tuple[DataFrame, dict[str, float]]:
    """Fill each column with its mean over the training rows only."""
    row = df.where(train).agg(*[F.avg(c).alias(c) for c in cols]).first()
    means = {c: row[c] for c in cols}
    return fill(df, means), means


def impute_with_indicator(df: DataFrame, cols: Sequence[str], values: dict[str, float] | None = None
                          ) -> tuple[DataFrame, dict[str, float]]:
    """Median fill plus a boolean ``<col>_na`` flag for every filled column."""
    values = values or fit_medians(df, cols)
    flagged = df.withColumns({f"{c}_na": F.col(c).isNull() for c in cols})
    return fill(flagged, values), values


def sparse_columns(df: DataFrame, min_share: float = 0.6, cols: Sequence[str] | None = None) -> list[str]:
    """Columns with fewer than int(min_share * rows) non-null values (one pass)."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    need = int(min_share * row["_n"])
    return [c for i, c in enumerate(cols) if row[f"c{i}"] < need]


def drop_sparse_columns(df: DataFrame, min_share: float = 0.6) -> DataFrame:
    return df.drop(*sparse_columns(df, min_share))


def missing_category(df: DataFrame, cols: Sequence[str], token: str = MISSING) -> DataFrame:
    """Categorical columns as strings with nulls replaced by ``token``."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(token)) for c in cols})


def presence_mask(df: DataFrame, cols: Sequence[str], suffix: str = "__present") -> DataFrame:
    """1 where the cell has a value, 0 where it is missing."""
    return df.withColumns({f"{c}{suffix}": F.col(c).isNotNull().cast("int") for c in cols})


# ----------------------------------------------------------------- encoding

def fit_categories(df: DataFrame, cols: Sequence[str], max_categories: int = 10000,
                   dropna: bool = True) -> dict[str, list]:
    """Sorted distinct values per column (numeric order for numbers, code-point
    order for strings).

    Two passes for all columns: an approximate distinct count proves the bound
    (raises above ``max_categories``), then one aggregate collects the sets,
    whose size is therefore bounded. The count keeps a sketch per column;
    ``approx_count_distinct`` of that accuracy has some 1,600 buffer columns
    each, whose generated code takes a minute for thirty columns.
    """
    cols = list(cols)
    if not cols:
        return {}
    est = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), 14)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    for i, c in enumerate(cols):
        if (est[f"n{i}"] or 0) > max_categories * 1.05:
            raise ValueError(f"{c}: more than {max_categories} categories")
    row = df.agg(*[F.collect_set(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        vals = list(row[f"s{i}"] or [])
        if len(vals) > max_categories:
            raise ValueError(f"{c}: more than {max_categories} categories")
        if not dropna and df.where(F.col(c).isNull()).limit(1).count():
            vals.append(None)
        out[c] = sorted(vals, key=lambda v: (v is None, v))
    return out


def fit_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, category, code) table: codes 0..k-1 of each column's distinct values in sorted order.

    Numbers sort as numbers, strings by code point. Any number of categories: the codes come from the distributed
    rank primitive over the distinct values, and nothing passes through the driver.
    """
    parts = []
    for c in cols:
        values = df.select(F.col(c).alias("_v")).where(F.col(c).isNotNull()).distinct()
        ranked = rank_within(values, [], "_v")
        parts.append(ranked.select(F.lit(c).alias("column"), F.col("_v").cast("string").alias("category"),
                                   (F.col("_rank") - 1).cast("int").alias("code")))
    return functools.reduce(DataFrame.unionByName, parts)


def label_encode_join(df: DataFrame, codes: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Codes of ``cols`` by joins with the table of :func:`fit_codes`; unseen values and nulls -> null.

    The planner chooses the join from the code table's size; a frequent value is left to the skew join.
    """
    for c in cols:
        own = codes.where(F.col("column") == c).select(F.col("category").alias("_category"), F.col("code").alias(f"{c}{suffix}"))
        df = df.join(own, F.col(c).cast("string") == F.col("_category"), "left").drop("_category")
    return df


def _dummy_name(col: str, value) -> str:
    return f"{col}_{value}"


def one_hot_drop_first(df: DataFrame, cats: dict[str, list], drop_original: bool = True) -> DataFrame:
    """0/1 columns ``<col>_<value>`` for every category but the first; a null
    row has all zeros."""
    cols = {}
    for c, values in cats.items():
        for v in values[1:]:
            cols[_dummy_name(c, v)] = F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("int")
    out = df.withColumns(cols)
    return out.drop(*cats) if drop_original else out


def dummy_columns(cats: dict[str, list]) -> list[str]:
    return [_dummy_name(c, v) for c, values in cats.items() for v in values[1:]]


# ------------------------------------------------------------------ scaling

def fit_standardize(df: DataFrame, cols: Sequence[str], train: Column | None = None,
                    floor: float = 1e-6) -> dict[str, tuple[float, float]]:
    """(mean, population std floored at ``floor``) per column over training rows."""
    src = df.where(train) if train is not None else df
    row = src.agg(*[e for c in cols for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return {c: (row[f"m_{c}"], max(row[f"s_{c}"] or 0.0, floor)) for c in cols}


def standardize(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


def fit_minmax(df: DataFrame, col: str, train: Column | None = None,
               widen: tuple[float, float] = (1.0, 1.0)) -> tuple[float, float]:
    """(min * widen[0], max * widen[1]) of ``col`` over training rows."""
    src = df.where(train) if train is not None else df
    row = src.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return row["lo"] * widen[0], row["hi"] * widen[1]


def minmax_scale(df: DataFrame, col: str, lo: float, hi: float, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, (F.col(col) - F.lit(lo)) / F.lit(hi - lo))


def minmax_inverse(df: DataFrame, col: str, lo: float, hi: float, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, F.col(col) * F.lit(hi - lo) + F.lit(lo))


# ------------------------------------------------------------------- splits

def hash_unit(id_col: str, seed: int, *extra: Column) -> Column:
    """A stable pseudo-random number in [0, 1) per row (and per extra key)."""
    h = F.xxhash64(F.col(id_col), F.lit(seed), *extra)
    return F.pmod(h, F.lit(1 << 30)).cast("double") / float(1 << 30)


def split_holdout(df: DataFrame, id_col: str, fractions: dict[str, float], seed: int = 42,
                  out: str = "split") -> DataFrame:
    """Label each row with a split drawn from ``fractions`` (e.g. train 0.8 / valid 0.2).

    The draw is a hash of (id, seed): stable under repartitioning and task
    retries, unlike ``randomSplit``.
    """
    u = hash_unit(id_col, seed)
    total, label = 0.0, F.lit(None).cast("string")
    bounds = []
    for name, frac in fractions.items():
        total += frac
        bounds.append((name, total))
    for name, hi in reversed(bounds):
        label = F.when(u < hi, name).otherwise(label)
    return df.withColumn(out, label)


def sample_rows(df: DataFrame, n: int, id_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows drawn with replacement (none from an empty table).

    Every draw is a hash of its number and the seed that picks a place in the order of the ids (must be unique), and is
    joined to the row at that place; so the draws depend on the ids alone, and are the same for every partitioning and
    task retry. Neither the rows nor the draws pass through one task.
    """
    rows = numbered(df, id_cols, "_place")
    total = df.count()
    if not total:
        return df.limit(0)
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(total)).alias("_place")
    return rows.join(df.sparkSession.range(n).select(draw), "_place").select(*df.columns)


# -------------------------------------------------------------------- noise

def mask_noise(df: DataFrame, cols: Sequence[str], lam: float, id_col: str, seed: int = 0,
               fill_value=None) -> DataFrame:
    """Each cell is kept with probability 1 - lam, otherwise set to ``fill_value``."""
    return df.withColumns({
        c: F.when(hash_unit(id_col, seed, F.lit(c)) >= lam, F.col(c)).otherwise(F.lit(fill_value))
        for c in cols})


def swap_noise(df: DataFrame, cols: Sequence[str], lam: float, id_col: str, seed: int = 0) -> DataFrame:
    """Each cell takes, with probability lam, the value of the same column in
    the row's partner under one random permutation of the rows.

    The permutation pairs the k-th row by id with the k-th row by hash(id,
    seed); both ranks come from the distributed rank primitive, and the
    partner values arrive by one equi-join on the rank.
    """
    by_id = rank_within(df.select(id_col), [], id_col).select(id_col, F.col("_rank").alias("_k"))
    # ranked by (hash, id): ids with equal hashes keep ranks of their own
    shuffled = df.select(F.struct(F.xxhash64(F.col(id_col), F.lit(seed)).alias("h"), F.col(id_col).alias("id")).alias("_h"))
    by_hash = rank_within(shuffled, [], "_h").select(F.col("_rank").alias("_k"), F.col("_h.id").alias("_partner"))
    partner_of = by_id.join(by_hash, "_k").select(id_col, "_partner")
    donor = df.select(F.col(id_col).alias("_partner"), *[F.col(c).alias(f"_d_{c}") for c in cols])
    j = df.join(partner_of, id_col, "left").join(donor, "_partner", "left")
    return j.withColumns({
        c: F.when(hash_unit(id_col, seed, F.lit(c)) < lam, F.col(f"_d_{c}")).otherwise(F.col(c))
        for c in cols}).drop("_partner", *[f"_d_{c}" for c in cols])


def clean_fill(df: DataFrame, cols: Sequence[str], order: Sequence[str],
               threshold: float = 1e10) -> DataFrame:
    """NaN/Inf and |x| > threshold -> missing, then forward fill in ``order``,
    then the (masked) column median for what is still missing."""
    from ..functions.nulls import magnitude_mask
    from .ordered import forward_fill

    masked = df.withColumns({c: magnitude_mask(c, threshold) for c in cols})
    med = fit_medians(masked, cols)
    return fill(forward_fill(masked, cols, order), med)


def prepare_tabular(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str,
                    split: str = "split", train: str = "train") -> tuple[DataFrame, dict]:
    """A model-ready table, all fitted on the rows whose ``split`` is ``train``.

    Presence masks, missing categories as a category of their own, codes (unseen values null), mean fill, standard
    scaling, and the target scaled to its training range as ``<target>_scaled``. Returns the table and the fitted state.
    """
    is_train = F.col(split) == train
    full = missing_category(presence_mask(df, [*numeric, *categorical]), categorical)
    coded = label_encode_join(full, fit_codes(full.where(is_train), categorical), categorical)
    filled, means = impute_mean_train(coded, numeric, is_train)
    scales = fit_standardize(filled, numeric, is_train)
    lo, hi = fit_minmax(df, target, is_train)
    return (minmax_scale(standardize(filled, scales), target, lo, hi, f"{target}_scaled"),
            {"means": means, "scales": scales, "target": (lo, hi)})
