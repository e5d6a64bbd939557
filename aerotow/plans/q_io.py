"""Registered queries: file sources and sinks (round trips through the shared
folder), and the day halo of the incremental trajectory run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trajectory as tr
from ..sources import files as io
from ..sources import fixtures as fx
from .catalog import normalise, register

HALO_DAY = "2024-01-15"
FLIGHT_CSV_SCHEMA = ("flight_id long, callsign string, adep string, ades string, actual_offblock_time timestamp_ntz, "
                     "arrival_time timestamp_ntz, flight_duration double, taxiout_time double, "
                     "flown_distance double, airline string, wtc string, aircraft_type string, tow double")


@register("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    f = fx.fx_flights_full(spark, sf).drop("country_code_adep", "country_code_ades")
    path = io.scratch_path(spark, "csv")
    io.write_csv(f, path)
    return io.scan_csv(spark, path, FLIGHT_CSV_SCHEMA).transform(normalise)


@register("day_partition_roundtrip")
def q_day_partition_roundtrip(spark, sf):
    t = fx.fx_traj(spark, sf).withColumn("file_date", F.date_format("timestamp", "yyyy-MM-dd"))
    path = io.scratch_path(spark, "days")
    io.write_daily(t, path)
    back = io.scan_day_parquet(spark, path)
    return back.select("flight_id", "event_id", "file_date", "altitude").transform(normalise)


@register("delim_noheader_roundtrip")
def q_delim_noheader_roundtrip(spark, sf):
    a = fx.fx_airports(spark, sf)
    path = io.scratch_path(spark, "delim")
    a.write.mode("overwrite").option("header", False).option("sep", ":").csv(path)
    return io.scan_delim_noheader(spark, path, ["icao", "lat", "lon", "altitude"], sep=":").transform(normalise)


@register("inline_rows")
def q_inline_rows(spark, sf):
    patch = fx.patch_airports(spark)
    used = fx.fx_flights(spark, sf).select(F.col("adep").alias("icao")).distinct()
    return patch.join(used, "icao", "left_semi")


@register("halo_days")
def q_halo_days(spark, sf):
    pts = tr.halo_slice(fx.fx_traj(spark, sf), HALO_DAY, 1)
    p = tr.assign_phases(pts, fx.fx_flights(spark, sf), fx.fx_airports(spark, sf))
    return tr.phase_summary(p).transform(normalise)
