"""Ties, hash collisions, open end bins, duplicate keys, unset folders, and days that arrive one by one."""

import pytest
from pyspark.sql import functions as F

from aerotow import session
from aerotow.operators import encode as en
from aerotow.operators import frame as fr
from aerotow.operators import ml, presets
from aerotow.operators import ranks
from aerotow.operators import tabular as tb
from aerotow.operators import trajectory as tr
from aerotow.sources import files as io
from aerotow.sources import fixtures as fx
from aerotow.streaming.daily import days_to_refresh, run_daily_stream

SF = "/root/testdata/sf0.001"


def test_swap_noise_keeps_rows_when_hashes_collide(spark, monkeypatch):
    df = spark.range(100).select(F.col("id"), (F.col("id") * 10).alias("v"))
    monkeypatch.setattr(en.F, "xxhash64", lambda *c: F.hash(*c).cast("long") % 5)
    out = en.swap_noise(df, ["v"], 0.5, "id", seed=1)
    rows = out.collect()
    assert len(rows) == 100 and len({r.id for r in rows}) == 100 and {r.v for r in rows} <= {10 * i for i in range(100)}


def test_sample_rows_with_replacement_is_exact_and_stable(spark):
    df = spark.range(500).select("id", (F.col("id") * 3).alias("v")).repartition(5)
    a, b = (sorted(r.id for r in en.sample_rows(x, 400, ["id"], 3).collect()) for x in (df, df.repartition(9)))
    assert a == b and len(a) == 400
    assert a != sorted(r.id for r in en.sample_rows(df, 400, ["id"], 4).collect())
    # rows repeat as often as independent draws do: 500 draws of 500 rows leave about a share 1/e out
    many = [r.id for r in en.sample_rows(df, 5000, ["id"]).collect()]
    counts = [many.count(i) for i in range(500)]
    assert len(many) == 5000 and max(counts) < 30 and sum((c - 10) ** 2 for c in counts) / 500 < 15
    once = {r.id for r in en.sample_rows(df, 500, ["id"], 9).collect()}
    assert 280 < len(once) < 350
    assert all(r.v == 3 * r.id for r in en.sample_rows(df, 50, ["id"]).collect())
    assert en.sample_rows(df.limit(0), 10, ["id"]).count() == 0


def test_ordered_operators_by_rows(spark, monkeypatch):
    """Composite and text keys, blocks of few rows in several groups, whatever the shuffle partitions."""
    from aerotow.operators import ordered as od

    monkeypatch.setattr(od, "BLOCK_ROWS", 20)
    monkeypatch.setattr(od, "GROUP", 3)
    rows = [(f"k{i // 7:03d}", i % 7, None if i % 3 else float(i), None if i % 50 else f"v{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "a string, b int, x double, y string").repartition(4)
    blocks = od._blocks(df, ["a", "b"], 1).groupBy("_b").count()
    assert blocks.count() >= 10 and blocks.agg(F.max("count")).first()[0] <= 60
    filled = {(r.a, r.b): (r.x, r.y) for r in od.forward_fill(df, ["x", "y"], ["a", "b"], 1).collect()}
    means = {(r.a, r.b): r.m for r in od.running_mean(df, "x", ["a", "b"], "m", 1).collect()}
    places = {(r.a, r.b): r.p for r in od.numbered(df, ["a", "b"], "p", 1).collect()}
    seen, x, y = [], None, None
    for i, (a, b, u, v) in enumerate(rows):
        x, y = u if u is not None else x, v if v is not None else y
        seen += [u] if u is not None else []
        assert filled[a, b] == (x, y) and places[a, b] == i and abs(means[a, b] - sum(seen) / len(seen)) < 1e-9


def test_label_codes_by_join(spark):
    df = spark.createDataFrame([(i, f"c{i % 300:03d}", None if i % 10 == 0 else i % 7) for i in range(900)], "id int, s string, k int")
    codes = en.fit_codes(df.where("id < 600"), ["s", "k"])
    got = en.label_encode_join(df.unionByName(spark.createDataFrame([(9999, "unseen", 99)], df.schema)), codes, ["s", "k"]).collect()
    for r in got:
        assert r.s_code == (None if r.s == "unseen" else int(r.s[1:])) and r.k_code == (r.k if r.k != 99 else None)


def test_rank_within_many_ties(spark):
    df = spark.range(70_000 * 2).select(F.lit(1).alias("v"))
    r = ranks.rank_within(df, [], "v").agg(F.count("*").alias("n"), F.min("_rank").alias("a"), F.max("_rank").alias("b"), F.count_distinct("_rank").alias("d")).first()
    assert tuple(r) == (140_000, 1, 140_000, 140_000)


def test_qcut_end_bins_are_open(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (3.0,), (6.0,), (99.0,), (None,)], "x double")
    got = [r[0] for r in df.select(tb.qcut_code(F.col("x"), [1.0, 2.0, 4.0, 6.0])).collect()]
    assert got == [0, 0, 1, 2, 2, None]


def test_reindex_refuses_duplicate_keys(spark):
    ids = spark.createDataFrame([(1, 0), (2, 1)], "k int, pos int")
    with pytest.raises(ValueError):
        fr.reindex_to_ids(ids, spark.createDataFrame([(1, 5), (1, 6)], "k int, v int"), "k")


def test_gbt_takes_a_categorical_of_200_values(spark):
    df = spark.createDataFrame([(i, float(i % 200), f"v{i % 200}", i % 5 == 0) for i in range(1000)], "id int, tow double, c string, is_valid boolean")
    model, info = ml.fit_gbt(df.withColumn("x", F.col("id") * 1.0), "tow", ["x"], ["c"], presets.QUICK["xgboost"].with_(max_rounds=2, depth=3), refit=False)
    assert ml.predict(model, df.withColumn("x", F.col("id") * 1.0), key="id", categorical=["c"], medians=info["medians"]).count() == 1000


def test_elbow_on_the_cost_table(spark):
    costs = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 40.0), (4, 30.0), (5, 29.0)], "k int, cost double")
    assert ml.elbow(costs, 0.01) == 3
    assert ml.elbow(costs.where("k <= 2"), 0.01) == 1


def test_unset_folder_is_refused_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_phased_points_are_read_without_a_shuffle(spark):
    """Between the written points and the first aggregate there is no exchange, and the scans are pruned."""
    feats = tr.trajectory_features(fx.fx_traj(spark, SF), fx.fx_flights(spark, SF), fx.fx_airports(spark, SF))

    def walk(node, above):
        name = node.nodeName()
        if "Scan" in name and "phased_points" in node.toString():
            scans.append((above, node.toString()))
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i), above + [name])
    scans: list = []
    plan = feats._jdf.queryExecution().sparkPlan() if False else feats._jdf.queryExecution().executedPlan()
    while "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.initialPlan()
    walk(plan, [])
    assert scans
    for above, text in scans:
        nearest = next(i for i in range(len(above) - 1, -1, -1) if "Aggregate" in above[i])
        assert not any("Exchange" in x for x in above[nearest + 1:])
        assert "u_component_of_wind" not in text or "groundspeed" in text


def test_days_to_refresh():
    present = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-05"]
    assert days_to_refresh(["2024-01-02"], present) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert days_to_refresh(["2024-01-05"], present) == ["2024-01-05"]


def test_days_arriving_one_by_one_end_with_the_batch_result(spark):
    order = ["2024-01-03", "2024-01-01", "2024-01-02"]  # apart, and not in order
    pts = (fx.fx_traj(spark, SF).withColumn("file_date", F.date_format("timestamp", "yyyy-MM-dd"))
           .where(F.col("file_date") <= "2024-01-03")).cache()
    flights, airports = fx.fx_flights(spark, SF), fx.fx_airports(spark, SF)
    store, out = io.scratch_path(spark, "t-days"), io.scratch_path(spark, "t-feats")
    for day in order:
        io.write_daily(pts.where(F.col("file_date") == day), store)
        run_daily_stream(spark, store, flights, airports, out, pts.schema)
    cols = ["flight_id", "flown_distance_ENR", "max_altitude_ENR", "kpi17_time"]
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)  # noqa: E731  sums in another order
    got = sorted(map(plain, spark.read.parquet(out).select(F.col("file_date").cast("string"), *cols).collect()), key=str)
    want = []
    for day in sorted(order):
        near = tr.halo_slice(pts, day, 1, date_col="file_date").drop("file_date")
        before = pts.where(F.col("file_date").cast("date") == F.date_sub(F.to_date(F.lit(day)), 1)).select("flight_id")
        own = pts.where(F.col("file_date") == day).select("flight_id").join(before, "flight_id", "left_anti").distinct()
        want += [(day, *r) for r in tr.trajectory_features(near.join(own, "flight_id", "left_semi"), flights, airports).select(*cols).collect()]
    assert got == sorted(map(plain, want), key=str)
    days = {(r[0], r[1]) for r in got}
    assert len(days) == len(got) and not any((f"2024-01-0{int(d[-1]) + 1}", f) in days for d, f in days)
