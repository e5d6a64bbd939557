"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (directly or through the stand-in
fixtures derived from them) and runs over all of their rows.  Doubles in
the results are normalised to 9 significant digits (the oracle applies the
same text rule) so that results of two engines can be compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.flight import STICKY_PAIRS
from ..operators import timeblocks, trajectory as tr
from ..sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def sig(c: Column, bits: int = 30) -> Column:
    """Round to ``bits`` significant binary digits (about 9 decimal digits).

    floor(x * 2^k + 0.5) / 2^k is bit-identical in any engine that gets the
    same x, and a value computed in two engines with sums in a different order
    (an ulp apart) almost never straddles a binary rounding point.  Decimal
    rounding is worse here: averages of short decimals often land exactly on
    a decimal tie.
    """
    k = F.lit(bits - 1) - F.floor(F.log2(F.abs(c)))
    scale = F.pow(F.lit(2.0), k.cast("double"))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.floor(c * scale + 0.5).cast("double") / scale)


def normalise(df: DataFrame, bits: int = 30) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(sig(F.col(f.name).cast("double"), bits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _phased(spark, sf):
    """Phased points written once (as ``trajectory_features`` does), so the
    branches inside each operator do not recompute the window chain."""
    return tr.materialize_phased(
        tr.assign_phases(fx.fx_traj(spark, sf), fx.fx_flights(spark, sf), fx.fx_airports(spark, sf)))


# ----------------------------------------------------------------- trajectory

@register("traj_phase_counts")
def q_traj_phase_counts(spark, sf):
    p = _phased(spark, sf)
    return p.groupBy("flight_id", "phase").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.sum("dist_adep").alias("sum_dist_adep"),
        F.sum("vertical_rate").alias("sum_vertical_rate")).transform(normalise)


@register("traj_phase_initial")
def q_traj_phase_initial(spark, sf):
    p = tr.assign_phases(fx.fx_traj(spark, sf), fx.fx_flights(spark, sf), fx.fx_airports(spark, sf),
                         sticky=False, short_route=False)
    return p.groupBy("phase").agg(F.count(F.lit(1)).alias("n_points"))


@register("sticky_phase")
def q_sticky_phase(spark, sf):
    p = timeblocks.sticky_labels(timeblocks.blocked(fx.fx_phase(spark, sf)), [("view", "click"), ("signup", "purchase")])
    return p.select("flight_id", "event_id", "phase")


@register("phase_summary")
def q_phase_summary(spark, sf):
    return tr.phase_summary(_phased(spark, sf)).transform(normalise)


@register("energy_10nm")
def q_energy_10nm(spark, sf):
    return tr.energy_10nm(_phased(spark, sf)).transform(normalise)


@register("liftoff")
def q_liftoff(spark, sf):
    return tr.liftoff(_phased(spark, sf)).transform(normalise)


@register("climb_samples")
def q_climb_samples(spark, sf):
    return tr.climb_samples(_phased(spark, sf)).transform(normalise)


@register("level_flight_flag")
def q_level_flight_flag(spark, sf):
    return tr.level_flight_flag(_phased(spark, sf)).transform(normalise)


@register("level_flight_kpi")
def q_level_flight_kpi(spark, sf):
    return tr.level_flight_kpi(_phased(spark, sf)).transform(normalise)


@register("trajectory_features")
def q_trajectory_features(spark, sf):
    t = tr.trajectory_features(fx.fx_traj(spark, sf), fx.fx_flights(spark, sf), fx.fx_airports(spark, sf))
    return t.transform(normalise)


# Further query groups register themselves on import.
from . import q_features  # noqa: E402,F401

from . import q_frame  # noqa: E402,F401

from . import q_encode  # noqa: E402,F401

from . import q_model  # noqa: E402,F401

from . import q_io  # noqa: E402,F401

from . import q_jobs  # noqa: E402,F401

from . import q_misc  # noqa: E402,F401


@register("trajectory_features_hot")
def q_trajectory_features_hot(spark, sf):
    """The flagship query with every flight cut into time blocks of about 20 points, as large flights are; must equal
    ``trajectory_features``."""
    t = tr.trajectory_features(fx.fx_traj(spark, sf), fx.fx_flights(spark, sf), fx.fx_airports(spark, sf),
                               block_points=20)
    return t.transform(normalise)
