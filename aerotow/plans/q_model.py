"""Registered queries: blend, metrics, submission, models (GBT, k-means, search, selection)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blend as bl
from ..operators import encode as en
from ..operators import frame as fr
from ..operators import ml
from ..operators import tabular as tb
from ..operators.presets import QUICK, SEARCH, SEARCH_TRIALS, SELECTION, SELECTION_STEPS
from ..sources import fixtures as fx
from .catalog import normalise, register
from .jobs import model_columns
from .q_frame import requested_ids

MODELS = list(fx.PREDICTION_MODELS)


@register("blend_weights")
def q_blend_weights(spark, sf):
    p = fx.fx_predictions(spark, sf)
    w = bl.fit_blend(p, MODELS, "tow")
    return spark.createDataFrame([tuple(w[m] for m in MODELS)],
                                 ", ".join(f"w_{m} double" for m in MODELS)).transform(normalise, 20)


def _model_tables(spark, sf):
    p = fx.fx_predictions(spark, sf)
    return {m: p.select("flight_id", F.col(m).alias("tow")) for m in MODELS}


@register("blend_apply")
def q_blend_apply(spark, sf):
    w = bl.fit_blend(fx.fx_predictions(spark, sf), MODELS, "tow")
    return bl.apply_blend(_model_tables(spark, sf), w).transform(normalise, 20)


@register("submission")
def q_submission(spark, sf):
    w = bl.fit_blend(fx.fx_predictions(spark, sf), MODELS, "tow")
    blended = bl.apply_blend(_model_tables(spark, sf), w)
    return fr.reindex_to_ids(requested_ids(spark, sf), blended, "flight_id").transform(normalise, 20)


@register("regression_metrics")
def q_regression_metrics(spark, sf):
    return ml.regression_metrics(fx.fx_predictions(spark, sf), "tow", "m_a").transform(normalise)


@register("group_rmse")
def q_group_rmse(spark, sf):
    f = tb.join_aircraft(fx.fx_flights(spark, sf), fx.fx_aircraft_faa(spark, sf)).select("flight_id", "Aircraft_Class")
    p = fx.fx_predictions(spark, sf).join(f, "flight_id")
    return ml.regression_metrics(p, "tow", "m_b", by="Aircraft_Class").transform(normalise)


def _scored_labels(spark, sf):
    lab = fx.table(spark, sf, "labels")
    score = ((F.col("doc_id") * 37) % 100).cast("double") / 100 * 0.7 + F.col("quality") * 0.25
    return lab.select("doc_id", "quality", score.alias("score"))


@register("classification_metrics")
def q_classification_metrics(spark, sf):
    return ml.classification_metrics(_scored_labels(spark, sf), "quality", "score").transform(normalise)


# ------------------------------------------------------------------ models

def model_frame(spark, sf):
    """Flights with calendar and aircraft features, and the columns that models learn from: (frame, numeric, categorical)."""
    f = tb.time_features(fx.fx_flights_full(spark, sf))
    f = tb.join_aircraft(f, fx.fx_aircraft_faa(spark, sf))
    f = en.split_holdout(f, "flight_id", {"train": 0.8, "valid": 0.2}, seed=42)
    numeric, categorical = model_columns(f)
    return fr.materialize(f.withColumn("is_valid", F.col("split") == "valid")), numeric, categorical


@register("gbt_predict")
def q_gbt_predict(spark, sf):
    f, numeric, categorical = model_frame(spark, sf)
    model, info = ml.fit_gbt(f, "tow", numeric, categorical, QUICK["xgboost"])
    unlabelled = f.where(F.col("tow").isNull()).drop("tow")
    scored = ml.predict(model, unlabelled, categorical=categorical, medians=info["medians"], keep=["MTOW_kg"])
    return tb.clip_to_bound(scored).select("flight_id", "tow")


@register("feature_importance")
def q_feature_importance(spark, sf):
    f, numeric, categorical = model_frame(spark, sf)
    model, info = ml.fit_gbt(f, "tow", numeric, categorical, QUICK["xgboost"], refit=False)
    return ml.feature_importance(spark, model, info["features"])


@register("recursive_selection")
def q_recursive_selection(spark, sf):
    f, numeric, categorical = model_frame(spark, sf)
    half = (len(numeric) + len(categorical)) // 2  # this frame has fewer columns than the selection keeps
    return ml.recursive_selection(f, "tow", numeric, categorical, half, SELECTION_STEPS, SELECTION)


@register("param_search")
def q_param_search(spark, sf):
    f, numeric, categorical = model_frame(spark, sf)
    return ml.param_search(f, "tow", numeric, categorical, n_trials=SEARCH_TRIALS, settings=SEARCH)


def _geo_frame(spark, sf):
    ap = tb.combine_airports([fx.fx_airports(spark, sf), fx.fx_airports_b(spark, sf), fx.patch_airports(spark)])
    return tb.join_airports(fx.fx_flights_full(spark, sf), ap)


@register("kmeans_geo")
def q_kmeans_geo(spark, sf):
    f = _geo_frame(spark, sf)
    model = ml.fit_geo_kmeans(ml.geo_points(f.where(F.col("tow").isNotNull())), k=20, seed=42)
    return ml.assign_clusters(f, model).select("flight_id", "adep_geo_cluster", "ades_geo_cluster")


@register("kmeans_elbow")
def q_kmeans_elbow(spark, sf):
    costs, pick = ml.kmeans_elbow(ml.geo_points(_geo_frame(spark, sf)), k_max=49)
    return costs.withColumn("picked_k", F.lit(pick))
