"""Registered queries: imputation, encoding, scaling, ordered fills, splits, noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as en
from ..operators import frame as fr
from ..operators import ordered as od
from ..operators import tabular as tb
from ..sources import fixtures as fx
from .catalog import normalise, register

AF_NUM = ["MTOW_kg", "MALW_kg", "Approach_Speed_knot", "mzfw_kg", "oew_kg", "tow"]
AF_CAT = ["aircraft_type", "wtc", "airline", "Manufacturer", "FAA_Weight", "Num_Engines"]
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _aircraft(spark, sf):
    return tb.join_aircraft(fx.fx_flights_full(spark, sf), fx.fx_aircraft_faa(spark, sf),
                            fx.fx_aircraft_extra(spark, sf))


@register("impute_median")
def q_impute_median(spark, sf):
    df, _ = en.impute_median(_aircraft(spark, sf), AF_NUM)
    return df.select("flight_id", *AF_NUM).transform(normalise)


@register("impute_mean_train")
def q_impute_mean_train(spark, sf):
    df, _ = en.impute_mean_train(_aircraft(spark, sf), AF_NUM, F.col("flight_id") % 10 < 8)
    return df.select("flight_id", *AF_NUM).transform(normalise)


@register("impute_with_indicator")
def q_impute_with_indicator(spark, sf):
    df, _ = en.impute_with_indicator(_aircraft(spark, sf), ["mzfw_kg", "tow"])
    return df.select("flight_id", "mzfw_kg", "tow", "mzfw_kg_na", "tow_na").transform(normalise)


@register("sparse_columns")
def q_sparse_columns(spark, sf):
    cols = en.sparse_columns(_aircraft(spark, sf), 0.7)
    return spark.createDataFrame([(c,) for c in cols], "column string")


@register("label_encode")
def q_label_encode(spark, sf):
    df = fr.materialize(en.missing_category(en.presence_mask(_aircraft(spark, sf), AF_CAT), AF_CAT))
    return en.label_encode_join(df, en.fit_codes(df, AF_CAT), AF_CAT).select(
        "flight_id", *[f"{c}__present" for c in AF_CAT], *[f"{c}_code" for c in AF_CAT])


@register("category_align")
def q_category_align(spark, sf):
    f = fx.fx_flights(spark, sf)
    train = f.where(F.substring("aircraft_type", 2, 3).cast("int") < 25)
    cols = ["aircraft_type", "airline"]
    return en.label_encode_join(f, en.fit_codes(train, cols), cols).select("flight_id", "aircraft_type_code", "airline_code")


@register("one_hot_align")
def q_one_hot_align(spark, sf):
    # the gate's categories differ between the labelled and the unlabelled flights
    f = fx.fx_flights_full(spark, sf).withColumn("gate", F.concat(F.lit("G"), (F.col("flight_id") % 10).cast("string")))
    lab, unl = f.where(F.col("tow").isNotNull()), f.where(F.col("tow").isNull())
    cols = ["wtc", "airline", "gate"]
    cats_train = en.fit_categories(lab, cols)
    cats_test = en.fit_categories(unl, cols)   # fitted separately, as the reference does
    train_cols = ["flight_id", *en.dummy_columns(cats_train)]
    test = fr.align_columns(en.one_hot_drop_first(unl, cats_test), train_cols)
    train = en.one_hot_drop_first(lab, cats_train).select(*train_cols)
    return fr.with_split_label(train, test)


@register("standardize_train")
def q_standardize_train(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    params = en.fit_standardize(li, LI_NUM, F.col("l_orderkey") % 10 < 9)
    return en.standardize(li, params).select("l_orderkey", "l_linenumber", "l_partkey", *LI_NUM).transform(normalise)


@register("target_minmax")
def q_target_minmax(spark, sf):
    f = fx.fx_flights_full(spark, sf)
    lo, hi = en.fit_minmax(f, "tow", F.col("tow").isNotNull(), widen=(0.95, 1.05))
    s = en.minmax_scale(f, "tow", lo, hi, "tow_scaled")
    s = en.minmax_inverse(s, "tow_scaled", lo, hi, "tow_back")
    return s.select("flight_id", "tow", "tow_scaled", "tow_back").transform(normalise)


def _orders_gappy(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("v"))


@register("running_mean_table")
def q_running_mean_table(spark, sf):
    return od.running_mean(_orders_gappy(spark, sf), "v", ["o_orderkey"], "mean_v").transform(normalise)


@register("ffill_table")
def q_ffill_table(spark, sf):
    return od.forward_fill(_orders_gappy(spark, sf), ["v"], ["o_orderkey"]).transform(normalise)


@register("clean_fill")
def q_clean_fill(spark, sf):
    o = fx.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") * 1e12)
         .when(F.col("o_orderkey") % 13 == 0, F.lit(None))
         .otherwise(F.col("o_totalprice")).alias("x"))
    return en.clean_fill(o, ["x"], ["o_orderkey"]).transform(normalise)


@register("split_holdout")
def q_split_holdout(spark, sf):
    """Every flight is in one split, the shares are near the asked ones, and a new partitioning changes nothing."""
    f = fx.fx_flights(spark, sf)
    one = en.split_holdout(f, "flight_id", {"train": 0.8, "valid": 0.2}, seed=42)
    two = en.split_holdout(f.repartition(7), "flight_id", {"train": 0.8, "valid": 0.2}, seed=42)
    both = one.select("flight_id", "split").join(two.select("flight_id", F.col("split").alias("again")), "flight_id")
    share = F.avg((F.col("split") == "train").cast("double"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count("split").alias("n_split"), share.between(0.75, 0.85).alias("share_ok"),
                    F.coalesce(F.min(F.col("split") == F.col("again")), F.lit(False)).alias("same"))


SAMPLE = 1000


@register("sample_rows")
def q_sample_rows(spark, sf):
    """The sample has as many rows as asked for, all from the table, and does not depend on the partitioning."""
    li = fx.table(spark, sf, "lineitem")
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    one, two = (en.sample_rows(x, SAMPLE, ids, seed=7).select(*ids) for x in (li, li.repartition(7)))
    return one.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(one.join(li, ids, "left_semi").count()).alias("n_found"), F.lit(one.exceptAll(two).count()).alias("n_other"))


@register("noise_mask_swap")
def q_noise_mask_swap(spark, sf):
    """Noise keeps the rows; masked and swapped shares are near the asked ones; other cells and the values stay."""
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    m = en.mask_noise(o, ["o_totalprice"], 0.1, "o_orderkey", seed=3)
    noisy = en.swap_noise(m, ["o_custkey"], 0.1, "o_orderkey", seed=5)
    j = noisy.join(o.select("o_orderkey", F.col("o_totalprice").alias("p"), F.col("o_custkey").alias("c")), "o_orderkey")
    strangers = noisy.join(o.select("o_custkey"), "o_custkey", "left_anti").count()
    masked = F.avg(F.col("o_totalprice").isNull().cast("double"))
    swapped = F.avg((F.col("o_custkey") != F.col("c")).cast("double"))
    return j.agg(F.count(F.lit(1)).alias("n"), masked.between(0.08, 0.12).alias("masked_ok"), swapped.between(0.07, 0.12).alias("swapped_ok"),
                 F.min(F.col("o_totalprice").isNull() | (F.col("o_totalprice") == F.col("p"))).alias("rest_same")).withColumn("strangers", F.lit(strangers))


PREP_NUM = ["MTOW_kg", "MALW_kg", "Approach_Speed_knot", "mzfw_kg"]
PREP_CAT = ["wtc", "airline", "FAA_Weight"]


@register("prepare_tabular")
def q_prepare_tabular(spark, sf):
    f = fr.materialize(_aircraft(spark, sf).withColumn("split", F.when(F.col("flight_id") % 10 < 8, "train").otherwise("valid")))
    out, _ = en.prepare_tabular(f, PREP_NUM, PREP_CAT, "tow")
    # a value filled with the mean scales to a rounding error, so these doubles are compared to six places
    near = [(F.round(c, 6) + 0.0).alias(c) for c in [*PREP_NUM, "tow_scaled"]]
    return out.select("flight_id", *[f"{c}_code" for c in PREP_CAT], "mzfw_kg__present", *near)
