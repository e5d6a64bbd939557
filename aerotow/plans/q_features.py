"""Registered queries: flight-list features (calendar, durations, routes,
products, bins, ratios, reference data, airport geometry)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frame as fr
from ..operators import tabular as tb
from ..operators import trajectory as tr
from ..sources import fixtures as fx
from .catalog import _phased, normalise, register

TIME_COLS = [f"{p}_{s}" for p in ("offblock", "arrival") for s in
             ("hour", "minute", "day_of_week", "day_of_year", "month", "week_of_year", "quarter",
              "year", "season", "weekday_name")] + [
    "offblock_to_arrival_duration", "is_offblock_weekend", "is_offblock_rush_hour",
    "is_arrival_weekend", "is_arrival_rush_hour", "offblock_to_arrival_day_diff"]

DURATION_COLS = ["flight_duration", "taxiout_time", "taxi_ratio", "flight_speed", "normalized_taxi_ratio",
                 "flight_duration_category", "speed_per_distance", "cumulative_avg_speed",
                 "avg_speed_ENR", "ENR_distance_ratio", "flight_time_excl_taxi"]

REGION_COLS = ["adep_region", "ades_region", "same_country_flight", "same_region_flight",
               "flight_direction", "is_intercontinental"]


def _phase_summary(spark, sf):
    """Phase summary written once to the shared folder: the fits that follow
    (medians, edges) each read it instead of recomputing the trajectory plan."""
    p = tr.materialize_phased(
        tr.assign_phases(fx.fx_traj(spark, sf), fx.fx_flights(spark, sf), fx.fx_airports(spark, sf)))
    return fr.materialize(tr.phase_summary(p))


@register("time_features")
def q_time_features(spark, sf):
    f = tb.time_features(fx.fx_flights_full(spark, sf))
    return f.select("flight_id", *TIME_COLS).transform(normalise)


@register("duration_features")
def q_duration_features(spark, sf):
    enr = _phase_summary(spark, sf).select("flight_id", "flown_distance_ENR")
    f = fx.fx_flights_full(spark, sf).join(enr, "flight_id", "left")
    return tb.duration_features(f).select("flight_id", *DURATION_COLS).transform(normalise)


@register("region_features")
def q_region_features(spark, sf):
    f = tb.region_features(fx.fx_flights_full(spark, sf))
    return f.select("flight_id", "country_code_adep", "country_code_ades", *REGION_COLS)


@register("interactions_ratios_bins")
def q_interactions_ratios_bins(spark, sf):
    # Features rounded first: quintile edges fall on tied values, and a tie
    # must compare equal in both engines of the check.
    f = fx.fx_flights_full(spark, sf).join(_phase_summary(spark, sf).transform(normalise), "flight_id")
    f = tb.ratios(tb.qcut(tb.interactions(f)))
    cols = ([f"{n}_{t}" for n, _, _ in tb.INTERACTIONS for t in tb.PHASE_TAGS]
            + list(tb.QCUT_COLUMNS) + list(tb.ratio_columns()))
    return f.select("flight_id", *cols).transform(normalise)


LINEITEM_BINS = {"q_bin": "l_quantity", "price_bin": "l_extendedprice", "disc_bin": "l_discount",
                 "tax_bin": "l_tax"}


@register("qcut_lineitem")
def q_qcut_lineitem(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return tb.qcut(li, LINEITEM_BINS).select("l_orderkey", "l_linenumber", "l_partkey", *LINEITEM_BINS)


@register("aircraft_features")
def q_aircraft_features(spark, sf):
    f = tb.join_aircraft(fx.fx_flights_full(spark, sf), fx.fx_aircraft_faa(spark, sf),
                         fx.fx_aircraft_extra(spark, sf))
    return f.drop("callsign", "adep", "ades", "actual_offblock_time", "arrival_time",
                  "flight_duration", "taxiout_time", "flown_distance", "airline", "wtc",
                  "country_code_adep", "country_code_ades").transform(normalise)


@register("airport_geometry")
def q_airport_geometry(spark, sf):
    ap = tb.combine_airports([fx.fx_airports(spark, sf), fx.fx_airports_b(spark, sf),
                              fx.patch_airports(spark)])
    f = tb.route_geometry(tb.join_airports(fx.fx_flights_full(spark, sf), ap))
    return f.select("flight_id", "Latitude_adep", "Longitude_adep", "Altitude_adep",
                    "Latitude_ades", "Longitude_ades", "Altitude_ades", "actual_distance",
                    "altitude_difference", "bearing", "elevation_gradient").transform(normalise)


@register("clip_to_mtow")
def q_clip_to_mtow(spark, sf):
    f = tb.join_aircraft(fx.fx_flights(spark, sf), fx.fx_aircraft_faa(spark, sf))
    f = f.withColumn("tow", F.col("tow") * 10)
    before = f.select("flight_id", F.col("tow").alias("tow_before"))
    out = tb.clip_to_bound(f).join(before, "flight_id")
    return out.select("flight_id", "tow_before", "tow", "MTOW_kg").transform(normalise)


@register("clip_counts")
def q_clip_counts(spark, sf):
    f = tb.join_aircraft(fx.fx_flights(spark, sf), fx.fx_aircraft_faa(spark, sf))
    return tb.clip_counts(f.withColumn("tow", F.col("tow") * 10))


@register("airport_altitude_units")
def q_airport_altitude_units(spark, sf):
    a, b = fx.fx_airports(spark, sf), fx.fx_airports_b(spark, sf)
    return tb.combine_airports([a, b], altitude_units=["ft", "m"]).select("icao", "altitude").transform(normalise)


@register("track_variation_circular")
def q_track_variation_circular(spark, sf):
    long = tr.phase_summary_long(_phased(spark, sf), wrap="circular")
    return long.select("flight_id", "phase", "track_variation").transform(normalise)
