"""Registered queries: single-operator checks (fallbacks, missing-value rules,
parsing, climb rate, model store, metric log)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import parse_timestamp
from ..functions.nulls import finite, magnitude_mask, safe_div
from ..operators import frame as fr
from ..operators import ml
from ..operators import trajectory as tr
from ..operators.presets import QUICK
from ..sources import files as io
from ..sources import fixtures as fx
from .catalog import normalise, register
from .q_model import model_frame


@register("airport_fallback")
def q_airport_fallback(spark, sf):
    p = tr.attach_airports(fx.fx_traj(spark, sf).select(*tr.POINT_COLS), fx.fx_flights(spark, sf),
                           fx.fx_airports(spark, sf))
    return p.select("flight_id", "adep_lon", "adep_lat", "ades_lon", "ades_lat").distinct().transform(normalise)


@register("climb_rate")
def q_climb_rate(spark, sf):
    p = tr.climb_rate(fx.fx_traj(spark, sf).select(*tr.POINT_COLS))
    return p.select("flight_id", "event_id", "vertical_rate").transform(normalise)


@register("inf_to_null")
def q_inf_to_null(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     finite(safe_div("l_tax", "l_discount")).alias("tax_per_discount"),
                     magnitude_mask(F.col("l_extendedprice") * 1e6, 5e10).alias("masked")).transform(normalise)


@register("parse_timestamp")
def q_parse_timestamp(spark, sf):
    o = fx.table(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 17 == 0, F.lit("not a date")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return (o.select("o_orderkey", parse_timestamp(raw).alias("ts"))
             .dropna(subset=["ts"]).select("o_orderkey", F.date_format("ts", "yyyy-MM-dd").alias("day")))


@register("model_roundtrip")
def q_model_roundtrip(spark, sf):
    f, numeric, categorical = model_frame(spark, sf)
    model, info = ml.fit_gbt(f, "tow", numeric, categorical, QUICK["xgboost"], refit=False)
    path = io.scratch_path(spark, "model")
    io.save_model(model, path)
    again = io.load_model(path)
    a = ml.predict(model, f, categorical=categorical, out="p1", medians=info["medians"])
    b = ml.predict(again, f, categorical=categorical, out="p2", medians=info["medians"])
    return a.join(b, "flight_id").select("flight_id", (F.col("p1") == F.col("p2")).alias("same"))


@register("metrics_log")
def q_metrics_log(spark, sf):
    p = fx.fx_predictions(spark, sf)
    m = ml.regression_metrics(p, "tow", "m_a").first()
    path = io.scratch_path(spark, "metrics")
    io.log_metrics(spark, path, "run-a", {"rmse": m["rmse"], "r2": m["r2"]}, {"model": "m_a"})
    io.log_metrics(spark, path, "run-b", {"rmse": m["rmse"]}, {"model": "m_a"})
    return spark.read.parquet(path).select("run", "metric", "value").transform(normalise)
