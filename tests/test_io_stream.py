"""Sources/sinks round trips and the incremental day stream."""

from pyspark.sql import functions as F

from aerotow.operators import trajectory as tr
from aerotow.sources import files as io
from aerotow.sources import fixtures as fx
from aerotow.streaming.daily import run_daily_stream

SF = "/root/testdata/sf0.001"


def test_csv_missing_markers(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, "x", float("nan"))], "id long, s string, v double")
    path = io.scratch_path(spark, "t-csv")
    io.write_csv(df, path)
    back = io.scan_csv(spark, path, "id long, s string, v double").orderBy("id").collect()
    assert back[0]["s"] is None and back[0]["v"] == 2.0
    assert back[1]["v"] is None          # NaN becomes missing on ingest


def test_daily_stream_matches_batch_halo(spark):
    pts = (fx.fx_traj(spark, SF).withColumn("file_date", F.date_format("timestamp", "yyyy-MM-dd"))
             .where(F.col("file_date") <= "2024-01-03"))
    store = io.scratch_path(spark, "t-days")
    io.write_daily(pts, store)
    out = io.scratch_path(spark, "t-feats")
    schema = pts.schema
    done = []
    run_daily_stream(spark, store, fx.fx_flights(spark, SF), fx.fx_airports(spark, SF), out, schema,
                     files_per_batch=100, on_day=done.append)
    assert sorted(done) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    got = spark.read.parquet(out).where("file_date = '2024-01-02'").drop("file_date")
    base = pts.drop("file_date")
    # a flight is published under its first day
    day1 = base.where(F.to_date("timestamp") == "2024-01-01").select("flight_id")
    exp = tr.trajectory_features(tr.halo_slice(base, "2024-01-02", 1).join(day1, "flight_id", "left_anti"),
                                 fx.fx_flights(spark, SF), fx.fx_airports(spark, SF))
    assert got.count() == exp.count()
    cols = ["flight_id", "flown_distance_ENR", "max_altitude_ENR", "kpi17_time"]
    a = sorted(got.select(*cols).collect())
    b = sorted(exp.select(*cols).collect())
    assert a == b
