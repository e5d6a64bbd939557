"""Trajectory points -> per-flight features.

Input points: flight_id, event_id (tiebreak for equal timestamps), timestamp,
latitude, longitude, altitude (ft), vertical_rate (ft/min), groundspeed (kt),
track (deg), u/v_component_of_wind (m/s), temperature (K), specific_humidity.

Plan shape: the points are hash-partitioned once, on ``flight_id`` and, where a
flight is larger than a block, on its time block (see ``timeblocks``); every
later window, aggregate and join is keyed by these (or a superset) and reuses
that partitioning, so the whole feature table costs one shuffle of the points.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flight import (STICKY_PAIRS, SUMMARY_MERGE, SUMMARY_PHASES,
                                airspeed, phase_initial, phase_short_route, specific_energy,
                                tailwind)
from ..functions.geo import KT_TO_MS, M_TO_NM, haversine_m, haversine_nm
from ..functions.nulls import clean_floats, finite, safe_div
from .dims import broadcast_bounded
from .sequence import KEY, ORDER, epoch_seconds
from ..session import MAX_BUCKETS, bucketed
from . import timeblocks as tb
from .ranks import order_stats

POINT_COLS = ["flight_id", "event_id", "timestamp", "latitude", "longitude", "altitude",
              "vertical_rate", "groundspeed", "track", "u_component_of_wind",
              "v_component_of_wind", "temperature", "specific_humidity"]

# Summary features per phase, in output order.
SUMMARY_FEATURES = ["track_variation", "average_vertical_rate", "average_airspeed", "groundspeed",
                    "wind_distance", "average_temperature", "average_humidity", "specific_energy",
                    "flown_distance", "average_altitude", "max_altitude", "cruise_altitude"]
SUM_FEATURES = {"wind_distance", "flown_distance"}
DROPPED_PIVOT = {"cruise_altitude_DEP_40", "cruise_altitude_ARR_100"}
SAMPLE_MEASURES = ["tas", "sqrd_tas", "temperature", "adep_height", "altitude", "specific_energy"]
N_SAMPLES = 10
TRIM = 0.05
# Trimmed-mean features of the phase summary: output name -> point column.
SUMMARY_MEASURES = {"average_vertical_rate": "vertical_rate", "average_airspeed": "airspeed",
                    "groundspeed": "gs_ms", "average_temperature": "temperature",
                    "average_humidity": "specific_humidity", "average_altitude": "altitude"}


def climb_rate(points: DataFrame, n: int = 10) -> DataFrame:
    """Fill missing vertical_rate with the rate over the next ``n`` samples (ft/min)."""
    d = tb.following(tb.blocked(points), ["altitude", "timestamp"], n, prefix="_ld_")
    dt = epoch_seconds("_ld_timestamp") - epoch_seconds("timestamp")
    vs = safe_div(F.col("_ld_altitude") - F.col("altitude"), dt) * 60
    return (d.withColumn("vertical_rate", F.coalesce(F.col("vertical_rate"), vs))
             .select(*points.columns))


def attach_airports(points: DataFrame, flights: DataFrame, airports: DataFrame,
                    max_airports: int = 200_000) -> DataFrame:
    """Left joins: points -> flight (adep, ades) -> airport coordinates by role.

    The airport table is a bounded dimension and is broadcast only after its
    row count is checked; the flight list is joined on ``flight_id``, which is
    also the partitioning of every later step.
    """
    f = flights.select("flight_id", "adep", "ades")
    ap = broadcast_bounded(airports.select("icao", "lat", "lon", "altitude"), max_airports)
    dep = ap.select(F.col("icao").alias("adep"), F.col("lon").alias("adep_lon"),
                    F.col("lat").alias("adep_lat"), F.col("altitude").alias("adep_altitude"))
    arr = ap.select(F.col("icao").alias("ades"), F.col("lon").alias("ades_lon"),
                    F.col("lat").alias("ades_lat"), F.col("altitude").alias("ades_altitude"))
    p = points.join(f, "flight_id", "left").join(dep, "adep", "left").join(arr, "ades", "left")
    # Missing airport coordinates fall back to the last / first point of the flight.
    o = F.struct(*ORDER)
    at = F.struct("longitude", "latitude")
    d = tb.flight_values(tb.blocked(p), _last=F.max_by(at, o), _first=F.min_by(at, o))
    return d.withColumns({
        "ades_lon": F.coalesce(F.col("ades_lon"), F.col("_last.longitude")),
        "ades_lat": F.coalesce(F.col("ades_lat"), F.col("_last.latitude")),
        "adep_lon": F.coalesce(F.col("adep_lon"), F.col("_first.longitude")),
        "adep_lat": F.coalesce(F.col("adep_lat"), F.col("_first.latitude")),
    }).select(*p.columns)


def assign_phases(points: DataFrame, flights: DataFrame, airports: DataFrame,
                  sticky: bool = True, short_route: bool = True, block_points: int | None = None) -> DataFrame:
    """Points with airport distances (NM) and a flight phase per point.

    Flights of more than ``block_points`` points are cut into time blocks; the result then has the columns ``blk``
    and ``split``.
    """
    return _phased(tb.with_blocks(clean_floats(points.select(*POINT_COLS)), block_points), flights, airports, sticky, short_route)


def _phased(points: DataFrame, flights: DataFrame, airports: DataFrame, sticky: bool = True, short_route: bool = True) -> DataFrame:
    p = attach_airports(climb_rate(points), flights, airports)
    p = p.withColumns({
        "dist_adep": haversine_nm("longitude", "latitude", "adep_lon", "adep_lat"),
        "dist_ades": haversine_nm("longitude", "latitude", "ades_lon", "ades_lat"),
        "dist_airp": haversine_nm("adep_lon", "adep_lat", "ades_lon", "ades_lat"),
    })
    p = p.withColumn("phase", phase_initial())
    if sticky:
        p = tb.sticky_labels(tb.blocked(p), STICKY_PAIRS).select(*p.columns)
    if short_route:
        p = p.withColumn("phase", phase_short_route(F.col("phase")))
    return p


def _physics(df: DataFrame) -> DataFrame:
    tail = tailwind()
    tas = airspeed("groundspeed", tail)
    return df.withColumns({"tailwind_speed": tail, "airspeed": tas,
                           "specific_energy": specific_energy(tas)})


def phase_summary_long(phased: DataFrame, wrap: str = "reference") -> DataFrame:
    """12 features per (flight, summary phase) present in the points.

    ``wrap``: how the track variation closes the circle. ``reference`` adds 360 to a value in radians, as the
    reference does; ``circular`` takes the smaller arc between the extreme tracks.
    """
    merge = F.create_map(*[x for kv in SUMMARY_MERGE.items() for x in map(F.lit, kv)])
    s = (tb.blocked(phased).where(F.col("phase").isin(*SUMMARY_MERGE))
           .withColumn("phase", merge[F.col("phase")]))
    keys = [KEY, "phase"]
    s = tb.previous(s, ["longitude", "latitude", "timestamp"], within=["phase"])
    prev_lon, prev_lat, prev_ts = F.col("_lag_longitude"), F.col("_lag_latitude"), F.col("_lag_timestamp")
    s = _physics(s).withColumns({
        "step_m": haversine_m("longitude", "latitude", prev_lon, prev_lat),
        "timelag": epoch_seconds("timestamp") - epoch_seconds(prev_ts),
        "track_rad": F.radians("track"),
        "gs_ms": F.col("groundspeed") * F.lit(KT_TO_MS),
    }).withColumn("wind_distance", F.col("tailwind_speed") * F.col("timelag"))
    plain = [
        F.max("track_rad").alias("_mx"), F.min("track_rad").alias("_mn"),
        F.coalesce(F.sum("wind_distance"), F.lit(0.0)).alias("wind_distance"),
        F.max_by("specific_energy", F.struct(*ORDER)).alias("specific_energy"),
        F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("flown_distance"),
        F.max("altitude").alias("max_altitude"),
    ]

    turn = {"reference": F.lit(360.0), "circular": F.lit(2 * math.pi)}[wrap]

    def with_track(df: DataFrame) -> DataFrame:
        return df.withColumn("track_variation", F.least(F.abs(F.col("_mx") - F.col("_mn")),
                                                        F.abs(F.col("_mx") - (F.col("_mn") + turn)))
                             ).drop("_mx", "_mn")

    # One pass: a rank window per measure (all on the partitioning of the points, so only sorts), then one aggregate
    # for plain sums, trimmed means and the 99th percentile together.
    grp = tb.in_block(["phase"])
    ranked = s.withColumns({
        **{f"_r_{o}": F.when(F.col(m).isNotNull(),
                             F.row_number().over(grp.orderBy(F.col(m).asc_nulls_last())))
           for o, m in SUMMARY_MEASURES.items()},
        **{f"_n_{o}": F.count(m).over(grp) for o, m in SUMMARY_MEASURES.items()},
    })
    aggs = list(plain)
    for o, m in SUMMARY_MEASURES.items():
        r, n = F.col(f"_r_{o}"), F.col(f"_n_{o}")
        k = F.floor(n * F.lit(TRIM))
        aggs.append(F.avg(F.when((r > k) & (r <= n - k), F.col(m))).alias(o))
    r, n = F.col("_r_average_altitude"), F.col("_n_average_altitude")
    h = (n - 1).cast("double") * F.lit(0.99)
    aggs += [F.max(F.when(r == F.floor(h) + 1, F.col("altitude"))).alias("_qlo"),
             F.max(F.when(r == F.ceil(h) + 1, F.col("altitude"))).alias("_qhi"),
             F.max(h - F.floor(h)).alias("_qd")]
    out = with_track(ranked.groupBy(*keys).agg(*aggs))
    out = (out.withColumn("cruise_altitude", F.col("_qlo") + (F.col("_qhi") - F.col("_qlo")) * F.col("_qd"))
              .drop("_qlo", "_qhi", "_qd"))
    if tb.BLK not in phased.columns:
        return out
    # ranks of split flights go over all their blocks
    names = [*SUMMARY_MEASURES, "cruise_altitude"]
    stats = order_stats(s.where(tb.SPLIT), keys, SUMMARY_MEASURES, trims={o: TRIM for o in SUMMARY_MEASURES},
                        quantiles={"cruise_altitude": ("average_altitude", 0.99)}, method="sort")
    split = s.where(tb.SPLIT).select(*keys).distinct().join(stats, keys, "left").select(*keys, F.struct(*names).alias("_split"))
    whole = F.col("_split").isNotNull()
    return out.join(split, keys, "left").withColumns({c: F.when(whole, F.col("_split")[c]).otherwise(F.col(c)) for c in names}).drop("_split")


def phase_summary(phased: DataFrame) -> DataFrame:
    """One row per flight: ``<feature>_<phase>`` for the three summary phases.

    Every flight with points gets all phases (the reference completes the
    (flight, phase) grid): for a phase without points the two sums are 0 and
    every other feature is null.
    """
    long = phase_summary_long(phased)
    aggs = []
    for feat in SUMMARY_FEATURES:
        for ph in SUMMARY_PHASES:
            name = f"{feat}_{ph}"
            if name in DROPPED_PIVOT:
                continue
            v = F.max(F.when(F.col("phase") == ph, F.col(feat)))
            if feat in SUM_FEATURES:
                v = F.coalesce(v, F.lit(0.0))
            aggs.append(v.alias(name))
    wide = long.groupBy(KEY).agg(*aggs)
    flights = phased.select(KEY).distinct()
    out = flights.join(wide, KEY, "left")
    return out.fillna(0.0, subset=[f"{f}_{p}" for f in SUM_FEATURES for p in SUMMARY_PHASES])


def energy_10nm(phased: DataFrame, max_nm: float = 10.0, start_nm: float = 2.0) -> DataFrame:
    """Energy, TAS and ground speed at the last climb point within ``max_nm``
    flown from the start of the DEP_40 climb (flights starting within ``start_nm``)."""
    c = tb.blocked(phased).where((F.col("phase") == "DEP_40") & (F.col("vertical_rate") > 0))
    c = tb.flight_values(c, _first=F.min_by("dist_adep", F.struct(*ORDER))).where(F.col("_first") < start_nm)
    c = tb.previous(c, ["longitude", "latitude"])
    step = F.coalesce(haversine_m("longitude", "latitude", "_lag_longitude", "_lag_latitude"), F.lit(0.0))
    c = tb.running_sum(c.withColumn("_step", step), "_step", "_cum_m")
    c = c.withColumn("_cum", F.col("_cum_m") * F.lit(M_TO_NM)).where(F.col("_cum") <= max_nm)
    c = _physics(c)
    o = F.struct("_cum", *ORDER)
    return c.groupBy(KEY).agg(
        F.max_by("specific_energy", o).alias("specific_energy"),
        F.max_by("airspeed", o).alias("tas_10NM"),
        F.max_by("groundspeed", o).alias("groundspeed_10NM"))


def _airborne_near_departure(phased: DataFrame, radius_nm: float) -> DataFrame:
    return (phased.where(F.col("dist_adep") < radius_nm)
                  .withColumn("adep_height", F.col("altitude") - F.col("adep_altitude"))
                  .where(F.col("adep_height") > 0))


def liftoff(phased: DataFrame, radius_nm: float = 2.0) -> DataFrame:
    """First airborne point near the departure airport."""
    a = _physics(_airborne_near_departure(phased, radius_nm))
    o = F.struct(*ORDER)
    return a.groupBy(KEY).agg(
        F.min_by("adep_height", o).alias("first_adep_height"),
        F.min_by("airspeed", o).alias("vlof_tas"),
        F.pow(F.min_by("airspeed", o), 2).alias("sqrd_vlof_tas"),
        F.min_by("groundspeed", o).alias("vlof_groundspeed"))


def climb_samples(phased: DataFrame, radius_nm: float = 2.0, n: int = N_SAMPLES) -> DataFrame:
    """The first ``n`` airborne points near departure, 6 measures each, wide."""
    a = _airborne_near_departure(phased, radius_nm)
    # the first n of every block, then of the flight
    a = tb.blocked(a).withColumn("n", F.row_number().over(tb.in_order())).where(F.col("n") <= n)
    a = tb.running_sum(a.withColumn("_one", F.lit(1)), "_one", "n").where(F.col("n") <= n)
    a = _physics(a).withColumnRenamed("airspeed", "tas").withColumn("sqrd_tas", F.pow("tas", 2))
    aggs = [F.max(F.when(F.col("n") == k, F.col(m))).alias(f"{m}_{k}")
            for m in SAMPLE_MEASURES for k in range(1, n + 1)]
    return a.groupBy(KEY).agg(*aggs)


def _before_top(base: DataFrame) -> DataFrame:
    """Rows before the first row at the flight's highest rounded altitude."""
    b = (tb.blocked(base).withColumn("alt2", F.bround("altitude", -2))
           .withColumn("time", epoch_seconds("timestamp")))
    b = tb.flight_values(b, altmax=F.max("alt2"))
    top = F.min(F.when(F.col("alt2") == F.col("altmax"), F.struct(*ORDER)))
    return tb.flight_values(b, _top=top).where(F.struct(*ORDER) < F.col("_top")).drop("_top")


def _level_time(df: DataFrame, vs_limit: float, extra=()) -> DataFrame:
    """``leveltime``: seconds to the next kept row while level, and ``_nx_<col>``, values on that row."""
    df = tb.following(df, ["time", *extra])
    lt = F.when(F.abs("vertical_rate") < vs_limit, F.col("_nx_time") - F.col("time")) \
          .otherwise(F.lit(0.0))
    return df.withColumn("leveltime", F.coalesce(lt, F.lit(0.0)))


def level_flight_flag(phased: DataFrame, radius_nm: float = 200.0, vs_limit: float = 300.0,
                      box: float = 0.99) -> DataFrame:
    """Flights with level time inside the top box before top of climb."""
    b = _before_top(_airborne_near_departure(phased, radius_nm))
    b = b.withColumn("altlimit2", F.col("altmax") * F.lit(box)).where(F.col("altitude") > F.col("altlimit2"))
    b = _level_time(b, vs_limit)
    g = b.groupBy(KEY).agg(F.sum("leveltime").alias("_t"), F.first("altlimit2").alias("altlimit2"))
    return g.where(F.col("_t") > 0).select(KEY, "altlimit2", F.lit(1).alias("box_flag"))


def level_flight_kpi(phased: DataFrame, flags: DataFrame | None = None, radius_nm: float = 200.0,
                     vs_limit: float = 300.0, box: float = 0.99) -> DataFrame:
    """Level-flight distance/time and climb distance/time below the altitude limit."""
    if flags is None:
        flags = level_flight_flag(phased, radius_nm, vs_limit, box)
    base = _airborne_near_departure(phased, radius_nm).join(flags, KEY, "left")
    b = _before_top(base)
    limit = F.when(F.coalesce(F.col("box_flag"), F.lit(0)) == 1, F.col("altlimit2")).otherwise(F.col("altmax"))
    b = b.where(F.col("altitude") < limit)
    b = _level_time(b, vs_limit, extra=("longitude", "latitude"))
    nxt = haversine_m("longitude", "latitude", "_nx_longitude", "_nx_latitude")
    b = b.withColumns({
        "leveldistance": F.coalesce(F.when(F.col("leveltime") > 0, nxt).otherwise(F.lit(0.0)), F.lit(0.0)),
        "flown_next": nxt,
    })
    o = F.struct(*ORDER)
    g = b.groupBy(KEY).agg(
        F.sum("leveldistance").alias("kpi17_distance"),
        F.sum("flown_next").alias("flown_distance_kpi17"),
        F.sum("leveltime").alias("kpi17_time"),
        (F.max_by("time", o) - F.min_by("time", o)).alias("transit_time_kpi17"))
    return g.fillna(0.0)


#: Points of a bucket of the phased points (about 100 bytes each).
BUCKET_POINTS = 1_000_000


def point_buckets(points: DataFrame, count: int | None = None) -> int:
    """Number of buckets for the points, from their count (a pass over one column, unless it is known)."""
    least = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = points.select(KEY).count() if count is None else count
    return min(MAX_BUCKETS, max(least, -(-count // BUCKET_POINTS)))


def materialize_phased(phased: DataFrame, buckets: int | None = None) -> DataFrame:
    """Write the phased points once to the shared folder, in buckets of the flight (and block).

    The feature branches read them from there: without a shuffle, as every step is keyed by these, and with
    column pruning. The written table also cuts the lineage (executor loss re-reads, not recomputes).
    """
    return bucketed(phased, tb.block_keys(phased), buckets or point_buckets(phased), "phased_points")


def trajectory_features(points: DataFrame, flights: DataFrame, airports: DataFrame,
                        materialize: bool = True, block_points: int | None = None) -> DataFrame:
    """One row per flight with points: 34 phase + 3 energy + 4 lift-off +
    60 sample + 4 level-flight features (105 columns after ``flight_id``).

    One plan for all flights: those of more than ``block_points`` points (``timeblocks.BLOCK_POINTS``) are cut into
    time blocks, so that no task holds a flight.
    """
    count, most = tb.point_counts(points)
    points = tb.with_blocks(clean_floats(points.select(*POINT_COLS)), block_points, most)
    buckets = point_buckets(points, count) if materialize else None
    if materialize:
        # the one shuffle of the points; windows, joins and the bucketed write keep to it
        points = points.repartition(buckets, *tb.block_keys(points))
    phased = _phased(points, flights, airports)
    if materialize:
        phased = materialize_phased(phased, buckets)
    return clean_floats(phase_summary(phased)
                        .join(energy_10nm(phased), KEY, "left")
                        .join(liftoff(phased), KEY, "left")
                        .join(climb_samples(phased), KEY, "left")
                        .join(level_flight_kpi(phased), KEY, "left"))


def halo_slice(points: DataFrame, day: str, halo: int = 1, date_col: str | None = None) -> DataFrame:
    """Points of the flights seen on ``day``, taken from ``day - halo .. day + halo``.

    With a day-partitioned source (``date_col``) both filters are partition
    filters; otherwise the day is the date of the timestamp.
    """
    d = F.to_date(F.lit(day))
    pday = F.col(date_col).cast("date") if date_col else F.to_date("timestamp")
    window = points.where(pday.between(F.date_sub(d, halo), F.date_add(d, halo)))
    ids = points.where(pday == d).select(KEY).distinct()
    return window.join(ids, KEY, "left_semi")
