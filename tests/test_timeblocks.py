"""Time blocks: every per-flight operator on flights cut into blocks gives what whole flights give."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from aerotow.functions.flight import PHASE_ORDER, STICKY_PAIRS
from aerotow.operators import timeblocks as tb
from aerotow.operators import trajectory as tr
from aerotow.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def noisy(spark):
    """Points of three flights with labels in any order, equal and null timestamps, a null flight; one flight has most points."""
    rng = random.Random(11)
    start, rows = dt.datetime(2024, 1, 1), []
    for flight, n in ((1, 900), (2, 60), (3, 7), (None, 40)):
        for i in range(n):
            t = None if rng.random() < 0.02 else start + dt.timedelta(seconds=rng.randrange(0, 20 * n))
            rows.append((flight, len(rows), t, rng.choice([*PHASE_ORDER, None, "other"]), rng.random()))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "flight_id bigint, event_id bigint, timestamp timestamp_ntz, phase string, x double").repartition(4).checkpoint()


def plain_sticky(labels, pairs):
    for frm, to in pairs:
        armed, out = False, []
        for i, x in enumerate(labels):
            armed |= i > 0 and labels[i - 1] == to and x == frm
            out.append(to if armed and x == frm else x)
        labels = out
    return labels


@pytest.mark.parametrize("size", [20, 100, 10_000])
def test_sticky_labels_against_plain(spark, noisy, size):
    cut = tb.with_blocks(noisy, size)
    assert (tb.BLK in cut.columns) == (size < 10_000)
    if size == 20:
        most = cut.where("flight_id = 1").agg(F.count_distinct("blk").alias("n")).first().n
        assert most > 20
    got = {r.event_id: r.phase for r in tb.sticky_labels(tb.blocked(cut), STICKY_PAIRS).collect()}
    by = {}
    assert got.keys() == {r.event_id for r in noisy.collect()}  # points without a flight stay, with their labels
    for r in sorted(noisy.where("flight_id is not null").collect(), key=lambda r: (r.timestamp is not None, r.timestamp or 0, r.event_id)):
        by.setdefault(r.flight_id, []).append(r)
    for rows in by.values():
        for r, want in zip(rows, plain_sticky([r.phase for r in rows], STICKY_PAIRS)):
            assert got[r.event_id] == want


@pytest.mark.parametrize("size", [20, 100])
def test_windows_over_blocks(spark, noisy, size):
    pts = noisy.where("flight_id is not null")
    w = Window.partitionBy("flight_id").orderBy("timestamp", "event_id")
    within = Window.partitionBy("flight_id", "phase").orderBy("timestamp", "event_id")
    want = {r.event_id: r for r in pts.select(
        "event_id", F.lag("x").over(w).alias("a"), F.lag("event_id").over(within).alias("b"), F.lead("event_id", 10).over(w).alias("c"),
        F.lead("x", 1).over(w).alias("d"), F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("e"),
        F.max("x").over(Window.partitionBy("flight_id")).alias("f")).collect()}
    d = tb.blocked(tb.with_blocks(pts, size))
    d = tb.previous(d, ["x"], prefix="a_")
    d = tb.previous(d.where("phase is not null"), ["event_id"], within=["phase"], prefix="b_").unionByName(d.where("phase is null").withColumn("b_event_id", F.lit(None).cast("bigint")))
    d = tb.following(tb.following(d, ["event_id"], 10, prefix="c_"), ["x"], prefix="d_")
    d = tb.flight_values(tb.running_sum(d, "x", "e"), f=F.max("x"))
    for r in d.collect():
        x = want[r.event_id]
        assert (r.a_x, r.c_event_id, r.d_x, r.f) == (x.a, x.c, x.d, x.f) and abs(r.e - x.e) < 1e-9
        if r.phase is not None:
            assert r.b_event_id == x.b


def test_half_of_all_points_in_one_flight(spark):
    """All features of a flight that holds half of the points, with blocks and without; no task reads the flight whole."""
    pts, flights, airports = fx.fx_traj(spark, SF).checkpoint(), fx.fx_flights(spark, SF).checkpoint(), fx.fx_airports(spark, SF).checkpoint()
    first = pts.select("flight_id").orderBy("flight_id").first()[0]
    merged = pts.withColumn("flight_id", F.when(F.col("event_id") % 2 == 0, F.lit(first)).otherwise(F.col("flight_id"))).checkpoint()
    cut = tb.with_blocks(merged, 50)
    sizes = cut.where(F.col("flight_id") == first).groupBy("blk").count()
    assert sizes.count() > 5 and sizes.agg(F.max("count")).first()[0] <= 100
    a = {r.flight_id: r for r in tr.trajectory_features(merged, flights, airports).collect()}
    b = {r.flight_id: r for r in tr.trajectory_features(merged, flights, airports, block_points=50).collect()}
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) <= 1e-9 * max(1.0, abs(x)))
