"""The three composite jobs of the reference, expressed as Spark plans.

A. ``trajectory_table``: trajectory points -> one row per flight with the
   105 trajectory features, joined to the flight list.
B. ``flight_feature_frame``: flight list + trajectory features + reference
   data -> model-ready frame (calendar, durations, regions, products, bins,
   ratios, aircraft, airports, geometry, geo clusters, one-hot + alignment).
C. ``train_blend_submit``: impute, split, boosted trees per model with
   patience and refit, bounded least-squares blend of the models on the
   validation rows, clip to MTOW, submission in the requested order.

Fitted state (medians, edges, categories, clusters, weights) is fitted on the
labelled rows and applied to both sets; ``fit_on="self"`` fits each set on
itself, as the reference notebooks do.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..operators import blend as bl
from ..operators import encode as en
from ..operators import frame as fr
from ..operators import ml
from ..operators import tabular as tb
from ..operators.presets import REFERENCE, Boosting
from ..operators.trajectory import trajectory_features
from ..session import written

# Columns removed after feature extraction, then before encoding.
COLUMNS_TO_REMOVE = ["name_adep", "name_ades", "country_code_adep", "country_code_ades",
                     "actual_offblock_time", "arrival_time", "flight_duration"]
COLUMNS_TO_REMOVE_2 = ["callsign", "adep", "ades", "date"]
# Categorical columns one-hot encoded (duplicates of the
# reference list removed).
CATEGORICAL = ["aircraft_type", "wtc", "airline", "offblock_hour", "offblock_minute", "offblock_day_of_week",
               "offblock_weekday_name", "offblock_month", "offblock_week_of_year", "offblock_season",
               "arrival_hour", "arrival_minute", "arrival_season", "arrival_weekday_name",
               "is_offblock_weekend", "is_offblock_rush_hour", "flight_duration_category", "adep_region",
               "ades_region", "same_country_flight", "same_region_flight", "flight_direction",
               "is_intercontinental", "Manufacturer", "Model_FAA", "Physical_Class_Engine", "FAA_Weight",
               "adep_geo_cluster", "ades_geo_cluster", "Aircraft_Class"]


def trajectory_table(points: DataFrame, flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Plan A: flight list inner-joined with the per-flight trajectory features."""
    return flights.join(trajectory_features(points, flights, airports), "flight_id")


def fit_tabular(fit: DataFrame) -> dict:
    """Fitted state of the tabular features: duration medians, quintile edges, ratio medians."""
    src = tb.time_features(fit)
    med = tb.fit_duration_medians(src)
    out = fr.materialize(tb.interactions(tb.region_features(tb.duration_features(src, med))))
    return {"durations": med, "edges": tb.fit_qcut(out, list(tb.QCUT_COLUMNS.values())),
            "ratios": tb.fit_ratio_medians(out)}


def apply_tabular(df: DataFrame, state: dict) -> DataFrame:
    """Calendar -> durations -> regions -> products -> bins -> ratios with fitted state."""
    out = tb.duration_features(tb.time_features(df), state["durations"])
    out = tb.qcut(tb.interactions(tb.region_features(out)), edges=state["edges"])
    return tb.ratios(out, state["ratios"])


def flight_feature_frame(flights: DataFrame, traj: DataFrame, faa: DataFrame, extra: DataFrame,
                         airport_sources: Sequence[DataFrame], fit_on: str = "labelled",
                         label: str = "tow", k_clusters: int = 20, max_categories: int = 10000
                         ) -> tuple[DataFrame, DataFrame]:
    """Plan B: (labelled frame, unlabelled frame) with aligned columns, target last."""
    base = fr.materialize(fr.dedupe_rows(flights.join(traj, "flight_id")))
    lab, unl = base.where(F.col(label).isNotNull()), base.where(F.col(label).isNull())
    st_lab = fit_tabular(lab)
    st_unl = fit_tabular(unl) if fit_on == "self" else st_lab
    lab_f, unl_f = apply_tabular(lab, st_lab), apply_tabular(unl, st_unl)
    airports = tb.combine_airports(airport_sources)
    parts = []
    for part in (lab_f, unl_f):
        p = fr.drop_columns(part, COLUMNS_TO_REMOVE)
        p = tb.join_aircraft(p, faa, extra)
        p = tb.route_geometry(tb.join_airports(p, airports))
        parts.append(fr.materialize(p))
    lab_p, unl_p = parts
    km = ml.fit_geo_kmeans(ml.geo_points(lab_p), k=k_clusters, seed=42)
    lab_p, unl_p = ml.assign_clusters(lab_p, km), ml.assign_clusters(unl_p, km)
    lab_p, unl_p = fr.drop_columns(lab_p, COLUMNS_TO_REMOVE_2), fr.drop_columns(unl_p, COLUMNS_TO_REMOVE_2)
    cats = [c for c in CATEGORICAL if c in lab_p.columns]
    cat_lab = en.fit_categories(lab_p, cats, max_categories)
    cat_unl = en.fit_categories(unl_p, cats, max_categories) if fit_on == "self" else cat_lab
    lab_e = fr.materialize(fr.target_last(en.one_hot_drop_first(lab_p, cat_lab), label))
    unl_e = fr.materialize(fr.align_columns(en.one_hot_drop_first(unl_p, cat_unl), lab_e.columns))
    return lab_e, unl_e


#: Columns that are no features: keys, the label and what only marks rows.
NO_FEATURES = ("flight_id", "callsign", "tow", "split", "is_valid")


def model_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns that a model learns from: all numbers and all strings but ``NO_FEATURES``."""
    kinds = {f.name: f.dataType for f in df.schema.fields if f.name not in NO_FEATURES}
    return [c for c, t in kinds.items() if isinstance(t, NumericType)], [c for c, t in kinds.items() if isinstance(t, StringType)]


def train_blend_submit(lab: DataFrame, unl: DataFrame, ids: DataFrame, numeric: Sequence[str],
                       categorical: Sequence[str] = (), models: dict[str, Boosting] = REFERENCE, seed: int = 42, label: str = "tow", key: str = "flight_id",
                       bound: str = "MTOW_kg", parallel: int = 3) -> tuple[DataFrame, dict]:
    """Plan C: boosted trees per model (patience + refit; ``parallel`` models at a time), blend weights fitted on the
    validation predictions, blended and clipped submission in ``ids`` order."""
    lab = fr.materialize(en.split_holdout(lab, key, {"train": 0.8, "valid": 0.2}, seed)
                         .withColumn("is_valid", F.col("split") == "valid"))
    valid_preds, test_preds, info = {}, {}, {}
    med = en.fit_medians(lab.where(F.col(label).isNotNull()), list(numeric))
    # the models learn from the same rows, and judge the same ones: each is made once
    on = ml.ready(lab, label, numeric, categorical, medians=med)

    def features(df: DataFrame, name: str) -> DataFrame:
        return written(ml.with_features(df, on.stages.stages, categorical, on.medians, [key]), name)
    held, test = features(lab.where("is_valid"), "valid-features"), features(unl, "test-features")
    with ThreadPoolExecutor(parallel) as pool:  # a fit is many short jobs, one after the other
        fits = {fl: pool.submit(ml.fit_gbt, lab, label, numeric, categorical, settings.with_(seed=seed), on=on) for fl, settings in models.items()}
    for fl, fit in fits.items():
        full, i2 = fit.result()
        early = i2.pop("early_model")
        valid_preds[fl] = early.stages[-1].transform(held).select(key, F.col("prediction").alias(f"p_{fl}"))
        test_preds[fl] = full.stages[-1].transform(test).select(key, F.col("prediction").alias("tow"))
        info[fl] = i2
    v = lab.where("is_valid").select(key, label)
    for fl, p in valid_preds.items():
        v = v.join(p, key)
    weights = bl.fit_blend(v, [f"p_{fl}" for fl in models], label)
    w = {fl: weights[f"p_{fl}"] for fl in models}
    blended = bl.apply_blend(test_preds, w, key)
    if bound in unl.columns:
        blended = tb.clip_to_bound(blended.join(unl.select(key, bound), key), "tow", bound)
    info["weights"] = w
    return fr.reindex_to_ids(ids, blended.select(key, "tow"), key), info
