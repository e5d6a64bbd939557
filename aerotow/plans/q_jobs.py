"""Registered queries: the composite jobs (trajectory table, feature frame, train/blend/submit)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frame as fr
from ..operators.presets import QUICK
from ..sources import fixtures as fx
from . import jobs
from .catalog import normalise, register
from .q_frame import requested_ids


def _frames(spark, sf):
    from ..operators.trajectory import trajectory_features
    traj = fr.materialize(trajectory_features(fx.fx_traj(spark, sf), fx.fx_flights(spark, sf),
                                              fx.fx_airports(spark, sf)))
    return jobs.flight_feature_frame(
        fx.fx_flights_full(spark, sf), traj, fx.fx_aircraft_faa(spark, sf), fx.fx_aircraft_extra(spark, sf),
        [fx.fx_airports(spark, sf), fx.fx_airports_b(spark, sf), fx.patch_airports(spark)])


@register("trajectory_table")
def q_trajectory_table(spark, sf):
    t = jobs.trajectory_table(fx.fx_traj(spark, sf), fx.fx_flights(spark, sf), fx.fx_airports(spark, sf))
    return t.transform(normalise)


@register("flight_feature_frame")
def q_flight_feature_frame(spark, sf):
    lab, unl = _frames(spark, sf)
    return fr.with_split_label(lab, unl)


@register("train_blend_submit")
def q_train_blend_submit(spark, sf):
    lab, unl = _frames(spark, sf)
    sub, _ = jobs.train_blend_submit(lab, unl, requested_ids(spark, sf), jobs.model_columns(lab)[0], models=QUICK)
    return sub
