"""Flight-list features: calendar, durations, routes, products, bins, ratios,
reference-data joins and airport geometry.

Fitted quantities (medians, quintile edges) are computed with one exact
distributed sort per stage (see ``ranks``) and returned to the driver as a
handful of scalars; ``transform`` steps are plain column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import (is_rush_hour, is_weekend, minutes_between, parse_timestamp,
                                  time_parts, whole_days_between)
from ..functions.flight import aircraft_class
from ..functions.geo import LB_TO_KG, bearing, haversine_km
from ..functions.nulls import finite, nullif_zero, safe_div
from ..functions.regions import add_regions, route_flags
from .dims import broadcast_bounded, dedupe_key_first
from .ordered import running_mean
from .ranks import medians, order_stats

# ------------------------------------------------------------------ calendar


def time_features(df: DataFrame, offblock: str = "actual_offblock_time",
                  arrival: str = "arrival_time") -> DataFrame:
    """Calendar parts of both timestamps, duration, weekend/rush flags, day difference.

    Rows whose timestamps are missing or unparsable are dropped.
    """
    df = df.withColumns({offblock: parse_timestamp(offblock), arrival: parse_timestamp(arrival)})
    df = df.dropna(subset=[offblock, arrival])
    df = df.withColumns(time_parts(F.col(offblock), "offblock"))
    df = df.withColumns(time_parts(F.col(arrival), "arrival"))
    return df.withColumns({
        "offblock_to_arrival_duration": minutes_between(offblock, arrival),
        "is_offblock_weekend": is_weekend("offblock_day_of_week"),
        "is_offblock_rush_hour": is_rush_hour("offblock_hour"),
        "is_arrival_weekend": is_weekend("arrival_day_of_week"),
        "is_arrival_rush_hour": is_rush_hour("arrival_hour"),
        "offblock_to_arrival_day_diff": whole_days_between(offblock, arrival),
    })


# ----------------------------------------------------------------- durations

# Duration buckets (minutes), left-closed.
DURATION_BINS = [(0.0, 60.0, "Very Short"), (60.0, 180.0, "Short"), (180.0, 300.0, "Medium"),
                 (300.0, float("inf"), "Long")]


def cut_fixed(x: Column, bins=DURATION_BINS) -> Column:
    """Label of the left-closed bin containing x; null outside all bins."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(bins):
        cond = x >= lo if hi == float("inf") else (x >= lo) & (x < hi)
        out = F.when(cond, label).otherwise(out)
    return out


def _duration_stage1(df: DataFrame) -> DataFrame:
    return df.withColumns({"flight_duration": nullif_zero("flight_duration").cast("double"),
                           "taxiout_time": nullif_zero("taxiout_time").cast("double")})


def fit_duration_medians(df: DataFrame) -> dict[str, float]:
    """The medians ``duration_features`` fills with, in the three dependent stages."""
    s1 = _duration_stage1(df)
    m = medians(s1, ["taxiout_time"])
    s2 = _duration_stage2(s1, m)
    m.update(medians(s2, ["taxi_ratio", "flight_speed", "avg_speed_ENR", "ENR_distance_ratio"]))
    s3 = _duration_stage3(s2, m)
    m.update(medians(s3, ["speed_per_distance"]))
    return m


def _fill(c: str, value) -> Column:
    return F.coalesce(F.col(c), F.lit(value).cast("double"))


def _duration_stage2(s1: DataFrame, m: dict) -> DataFrame:
    s = s1.withColumn("taxiout_time", _fill("taxiout_time", m["taxiout_time"]))
    return s.withColumns({
        "taxi_ratio": safe_div("taxiout_time", "flight_duration"),
        "flight_speed": finite(safe_div("flown_distance", "flight_duration")),
        "avg_speed_ENR": finite(safe_div("flown_distance_ENR",
                                         F.col("flight_duration") - F.col("taxiout_time"))),
        "ENR_distance_ratio": finite(safe_div("flown_distance_ENR", "flown_distance")),
    })


def _duration_stage3(s2: DataFrame, m: dict) -> DataFrame:
    s = s2.withColumn("flight_speed", _fill("flight_speed", m["flight_speed"]))
    return s.withColumn("speed_per_distance", finite(safe_div("flight_speed", "flown_distance")))


def duration_features(df: DataFrame, medians_: dict[str, float] | None = None,
                      order: Sequence[str] = ("flight_id",)) -> DataFrame:
    """Duration/speed features; zero durations are missing, gaps are median-filled.

    ``cumulative_avg_speed`` is the expanding mean of ``flight_speed`` in
    ``order`` (the row order of the flight list).
    """
    m = medians_ or fit_duration_medians(df)
    s = _duration_stage3(_duration_stage2(_duration_stage1(df), m), m)
    s = s.withColumns({
        "taxi_ratio": _fill("taxi_ratio", m["taxi_ratio"]),
        "speed_per_distance": _fill("speed_per_distance", m["speed_per_distance"]),
        "avg_speed_ENR": _fill("avg_speed_ENR", m["avg_speed_ENR"]),
        "ENR_distance_ratio": _fill("ENR_distance_ratio", m["ENR_distance_ratio"]),
        "flight_duration_category": cut_fixed(F.col("flight_duration")),
        "flight_time_excl_taxi": F.col("flight_duration") - F.col("taxiout_time"),
    })
    # Filling with the median leaves the median unchanged, so the fitted one is used.
    s = s.withColumn("normalized_taxi_ratio", safe_div("taxi_ratio", F.lit(m["taxi_ratio"])))
    return running_mean(s, "flight_speed", list(order), "cumulative_avg_speed")


# ------------------------------------------------------------------- routes


def region_features(df: DataFrame) -> DataFrame:
    return route_flags(add_regions(df))


# Interaction products (name stem, left feature stem, right feature stem).
INTERACTIONS = [
    ("airspeed_specific_energy", "average_airspeed", "specific_energy"),
    ("groundspeed_flown_distance", "groundspeed", "flown_distance"),
    ("humidity_temperature", "average_humidity", "average_temperature"),
    ("vertical_rate_airspeed", "average_vertical_rate", "average_airspeed"),
    ("altitude_groundspeed", "average_altitude", "groundspeed"),
]
# Short phase tag -> phase column suffix.
PHASE_TAGS = {"ARR": "ARR_100", "DEP": "DEP_40", "ENR": "ENR"}


def interactions(df: DataFrame, spec=INTERACTIONS) -> DataFrame:
    """15 products: every spec entry for the ARR, DEP and ENR phases."""
    return df.withColumns({
        f"{name}_{tag}": F.col(f"{a}_{ph}") * F.col(f"{b}_{ph}")
        for name, a, b in spec for tag, ph in PHASE_TAGS.items()})


# Ratio features (name stem, numerator stem, denominator stem).
RATIOS = [
    ("vertical_rate_airspeed_ratio", "average_vertical_rate", "average_airspeed"),
    ("wind_distance_flown_distance", "wind_distance", "flown_distance"),
    ("groundspeed_airspeed_ratio", "groundspeed", "average_airspeed"),
]


def ratio_columns(spec=RATIOS) -> dict[str, tuple[str, str]]:
    return {f"{name}_{tag}": (f"{a}_{ph}", f"{b}_{ph}")
            for name, a, b in spec for tag, ph in PHASE_TAGS.items()}


def fit_ratio_medians(df: DataFrame, spec=RATIOS) -> dict[str, float]:
    rc = ratio_columns(spec)
    raw = df.select(*[finite(safe_div(a, b)).alias(n) for n, (a, b) in rc.items()])
    return medians(raw, list(rc))


def ratios(df: DataFrame, medians_: dict[str, float] | None = None, spec=RATIOS) -> DataFrame:
    """9 quotients; division by zero and missing operands give the median."""
    m = medians_ or fit_ratio_medians(df, spec)
    return df.withColumns({
        n: F.coalesce(finite(safe_div(a, b)), F.lit(m[n]).cast("double"))
        for n, (a, b) in ratio_columns(spec).items()})


# ------------------------------------------------------------ quintile bins

# Columns binned into quintiles (output name -> input column).
QCUT_COLUMNS = {
    "temperature_bins_ARR": "average_temperature_ARR_100",
    "temperature_bins_DEP": "average_temperature_DEP_40",
    "humidity_bins_ARR": "average_humidity_ARR_100",
    "humidity_bins_DEP": "average_humidity_DEP_40",
    "vertical_rate_bins_ARR": "average_vertical_rate_ARR_100",
    "vertical_rate_bins_DEP": "average_vertical_rate_DEP_40",
    "flight_duration_bins": "flight_duration",
    "flown_distance_bins": "flown_distance",
}


def fit_qcut(df: DataFrame, cols: Sequence[str], q: int = 5) -> dict[str, list[float]]:
    """Exact quantile edges (0, 1/q, ..., 1) per column, duplicates removed.

    All columns and probabilities come from one distributed sort.
    """
    cols = list(dict.fromkeys(cols))
    probs = {f"{c}__e{i}": (c, i / q) for c in cols for i in range(q + 1)}
    row = order_stats(df, [], {c: c for c in cols}, quantiles=probs).first()
    edges = {}
    for c in cols:
        vals = [row[f"{c}__e{i}"] for i in range(q + 1)] if row is not None else []
        edges[c] = sorted({v for v in vals if v is not None})
    return edges


def qcut_code(x: Column, edges: Sequence[float]) -> Column:
    """Bin index for right-closed bins over ``edges``, lowest edge included.

    The end bins are open: a value outside the edges, which were fitted on other rows, belongs to the first or the
    last bin. Null stays null.
    """
    if len(edges) < 2:
        return F.lit(None).cast("int")
    below = sum((F.when(x > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(x.isNotNull(), F.least(F.greatest(below - 1, F.lit(0)), F.lit(len(edges) - 2))).cast("int")


def qcut(df: DataFrame, columns: dict[str, str] = QCUT_COLUMNS,
         edges: dict[str, list[float]] | None = None, q: int = 5) -> DataFrame:
    edges = edges or fit_qcut(df, list(columns.values()), q)
    return df.withColumns({out: qcut_code(F.col(c), edges[c]) for out, c in columns.items()})


# ----------------------------------------------------------- reference data

FAA_COLUMNS = ["MTOW_lb", "MALW_lb", "Manufacturer", "Model_FAA", "Physical_Class_Engine",
               "Num_Engines", "Approach_Speed_knot", "FAA_Weight"]


def join_aircraft(df: DataFrame, faa: DataFrame, extra: DataFrame | None = None,
                  max_types: int = 100_000) -> DataFrame:
    """⟕ FAA characteristics (MTOW/MALW in kg, class) ⟕ extra aircraft table."""
    f = faa.select(F.col("FAA_Designator").alias("aircraft_type"), *FAA_COLUMNS)
    f = f.withColumns({"MTOW_kg": F.col("MTOW_lb") * F.lit(LB_TO_KG),
                       "MALW_kg": F.col("MALW_lb") * F.lit(LB_TO_KG)}).drop("MTOW_lb", "MALW_lb")
    out = df.join(broadcast_bounded(f, max_types), "aircraft_type", "left")
    out = out.withColumn("Aircraft_Class", aircraft_class())
    if extra is not None:
        out = out.join(broadcast_bounded(extra, max_types), "aircraft_type", "left")
    return out


FT_TO_M = 0.3048


def combine_airports(sources: Sequence[DataFrame], altitude_units: Sequence[str] | None = None) -> DataFrame:
    """Union of airport sources (icao, lat, lon, altitude); first source wins per code.

    Within one source the earliest line wins (``line`` column if present). ``altitude_units`` gives each source's
    unit; altitudes in ``m`` are turned into feet, the unit of the result (default: all in ``ft``).
    """
    parts = []
    units = list(altitude_units or ["ft"] * len(sources))
    if len(units) != len(sources) or set(units) - {"ft", "m"}:
        raise ValueError("altitude_units: one of 'ft' or 'm' for each source")
    for rank, s in enumerate(sources):
        if units[rank] == "m":
            s = s.withColumn("altitude", F.col("altitude") / F.lit(FT_TO_M))
        line = F.col("line") if "line" in s.columns else F.lit(0)
        parts.append(s.select("icao", "lat", "lon", "altitude",
                              F.lit(rank).alias("source_rank"), line.cast("long").alias("line")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return dedupe_key_first(u.where(F.col("icao").isNotNull()), "icao",
                            ["source_rank", "line"]).drop("source_rank", "line")


def join_airports(df: DataFrame, airports: DataFrame, max_airports: int = 200_000) -> DataFrame:
    """Latitude/Longitude/Altitude_{adep,ades} by two left joins of one broadcast table."""
    ap = broadcast_bounded(airports.select("icao", "lat", "lon", "altitude"), max_airports)
    for role in ("adep", "ades"):
        a = ap.select(F.col("icao").alias(role), F.col("lat").alias(f"Latitude_{role}"),
                      F.col("lon").alias(f"Longitude_{role}"), F.col("altitude").alias(f"Altitude_{role}"))
        df = df.join(a, role, "left")
    return df


def route_geometry(df: DataFrame) -> DataFrame:
    """Great-circle distance (km), altitude difference, bearing, elevation gradient."""
    return df.withColumns({
        "actual_distance": haversine_km("Latitude_adep", "Longitude_adep", "Latitude_ades", "Longitude_ades"),
        "altitude_difference": F.col("Altitude_ades") - F.col("Altitude_adep"),
        "bearing": bearing("Latitude_adep", "Longitude_adep", "Latitude_ades", "Longitude_ades"),
    }).withColumn("elevation_gradient", finite(safe_div("altitude_difference", "actual_distance")))


def clip_to_bound(df: DataFrame, col: str = "tow", bound: str = "MTOW_kg") -> DataFrame:
    """col = bound where col > bound; a missing bound leaves the value."""
    return df.withColumn(col, F.when(F.col(col) > F.col(bound), F.col(bound)).otherwise(F.col(col)))


def clip_counts(df: DataFrame, col: str = "tow", bound: str = "MTOW_kg") -> DataFrame:
    """One row: rows over the bound before :func:`clip_to_bound`, and after it."""
    over = F.sum((F.col(col) > F.col(bound)).cast("long"))
    before = df.agg(F.coalesce(over, F.lit(0)).alias("over_before"), F.count(F.lit(1)).alias("n"))
    after = clip_to_bound(df, col, bound).agg(F.coalesce(over, F.lit(0)).alias("over_after"))
    return df.sparkSession.createDataFrame([(before.first()["over_before"], after.first()["over_after"], before.first()["n"])],
                                           "over_before long, over_after long, n long")
