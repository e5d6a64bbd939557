"""Physical-plan properties that matter at scale."""

import re

from aerotow.operators import trajectory as tr
from aerotow.operators import ordered as od
from aerotow.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trajectory_points_shuffled_once(spark):
    phased = tr.assign_phases(fx.fx_traj(spark, SF), fx.fx_flights(spark, SF), fx.fx_airports(spark, SF))
    plan = _plan(phased)
    # windows over flights: every Window is partitioned (no single-partition window on points)
    assert "Window" in plan
    assert not re.search(r"Window \[.*\], \[\], \[", plan)
    # airports join is a broadcast join
    assert "BroadcastHashJoin" in plan
    # no flight exceeds a block: the carries of blocks are not in the plan
    assert "_tail" not in plan and "_heads" not in plan and "_whole" not in plan.replace("null AS _whole", "")


def test_points_are_dealt_once(spark):
    """All columns of the points are shuffled once, to be written; the label changes take five narrow columns."""
    pts = fx.fx_traj(spark, SF).checkpoint()
    phased = tr._phased(pts.select(*tr.POINT_COLS).repartition(8, "flight_id"), fx.fx_flights(spark, SF).checkpoint(), fx.fx_airports(spark, SF).checkpoint())
    lines = _plan(phased).splitlines()
    dealt = [lines[i + 1] for i, x in enumerate(lines) if "REPARTITION_BY_NUM" in x]
    assert len(dealt) == 2
    narrow = [x for x in dealt if "Project" in x]
    assert len(narrow) == 1 and narrow[0].count("#") == 5


def test_ordered_ops_use_bucket_windows(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice")
    plan = _plan(od.running_mean(o, "o_totalprice", ["o_orderkey"], "m"))
    assert "BroadcastHashJoin" in plan       # carry table of a row per block
    # the only window without a partition spec runs on the P-row bucket table
    big = [l for l in plan.splitlines() if re.search(r"Window \[.*\], \[\], \[", l)]
    assert len(big) <= 1
