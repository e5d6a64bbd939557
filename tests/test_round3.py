"""Model queries of many columns and trials: plans and runs that must not be repeated or grow with the columns."""

import threading
import time

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from aerotow.operators import boosting, encode, ml, presets, ranks, search
from aerotow.plans import jobs
from aerotow.session import shared_path

SMALL = presets.Boosting(depth=3, rate=0.5, least_rows=2, max_rounds=12, patience=2)


@pytest.fixture(scope="module")
def flights(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b) if i % 9 else None, "pq"[i % 2], float(4 * a + rng.normal()) if i % 5 else None, 3.0, i % 4 == 0)
            for i, (a, b) in enumerate(rng.random((400, 2)))]
    return spark.createDataFrame(rows, "flight_id long, a double, b double, k string, tow double, MTOW_kg double, is_valid boolean").repartition(2).checkpoint()


def test_best_round_needs_no_second_training(flights, monkeypatch):
    x = VectorAssembler(inputCols=["a"], outputCol="features").transform(flights.where("tow is not null")).withColumn("label", F.col("tow"))
    train, held = x.where("not is_valid").checkpoint(), x.where("is_valid").checkpoint()
    ran, plain = [], boosting.regressor
    monkeypatch.setattr(boosting, "regressor", lambda s, rounds, *a: ran.append(rounds) or plain(s, rounds, *a))
    got = boosting.fit_patient(train, held, SMALL)
    assert ran == [12] and got.rounds < 12 and got.model.getNumTrees == got.rounds == got.model.getMaxIter()
    again = plain(SMALL, got.rounds).fit(train)
    assert [r.prediction for r in got.model.transform(held).collect()] == [r.prediction for r in again.transform(held).collect()]
    assert got.model.featureImportances == again.featureImportances and got.model.numFeatures == again.numFeatures


def test_medians_of_many_columns(spark):
    values = {"a.b": [3.0, None, 1.0, 2.5], "none": [None] * 4, **{f"c{i}": [float(i), i + 1.0, float("nan"), None] for i in range(400)}}
    df = spark.createDataFrame([*zip(*values.values())], ", ".join(f"`{c}` double" for c in values)).withColumnRenamed("a.b", "ab")
    begun = time.time()
    got = ranks.medians(df, df.columns)
    assert time.time() - begun < 60  # three aggregates a column, renamed one by one, took minutes
    assert got["ab"] == 2.5 and got["none"] is None and all(got[f"c{i}"] == i + 1 for i in range(400))
    few = ["ab", "none", "c7"]
    assert ranks.quantiles(df, few).first().asDict() == {c: got[c] for c in few}
    assert ranks.medians(df.limit(0), few) == dict.fromkeys(few) and ranks.medians(df, []) == {}


def test_categories_of_many_columns(spark):
    df = spark.range(300).select(*[(F.col("id") % (i + 2)).cast("string" if i % 2 else "double").alias(f"c{i}") for i in range(30)], F.lit(None).cast("int").alias("none"))
    begun = time.time()
    got = encode.fit_categories(df, df.columns)
    assert time.time() - begun < 30
    assert got["none"] == [] and got["c2"] == [0.0, 1.0, 2.0, 3.0] and got["c1"] == ["0", "1", "2"] and len(got["c29"]) == 31
    with pytest.raises(ValueError):
        encode.fit_categories(df, ["c29"], max_categories=20)


def test_random_trials_do_not_wait_for_a_batch(spark):
    later = threading.Event()

    def objective(p):
        if p == first:
            assert later.wait(60)  # ends only once a trial of the next batch runs
        else:
            seen.append(p)
            if len(seen) == 3:
                later.set()
        return p["x"]
    space, seen = {"x": ("uniform", 0.0, 1.0)}, []
    first = search.propose(space, [], np.random.default_rng([3, 0]))
    out = search.minimise(spark, objective, space, 6, shared_path(spark, f"trials-wait-{time.time()}"), seed=3, parallel=2)
    assert out.count() == 6


def test_models_learn_from_rows_made_once(flights, monkeypatch):
    made, plain = [], ml.prepare
    monkeypatch.setattr(ml, "prepare", lambda *a, **k: made.append(1) or plain(*a, **k))
    lab, unl = flights.where("tow is not null").drop("is_valid"), flights.where("tow is null").drop("is_valid", "tow")
    models = {"m": SMALL, "n": SMALL.with_(depth=2)}
    sub, info = jobs.train_blend_submit(lab, unl, unl.select("flight_id", F.col("flight_id").alias("pos")), ["a", "b"], ["k"], models)
    rows = sub.collect()
    assert made == [1] and set(info["weights"]) == set(models) and len(rows) == 80 and all(r.tow <= 3.0 for r in rows)
    full = ml.fit_gbt(encode.split_holdout(lab, "flight_id", {"train": 0.8, "valid": 0.2}, 42).withColumn("is_valid", F.col("split") == "valid"),
                      "tow", ["a", "b"], ["k"], SMALL)
    alone = {r.flight_id: r.tow for r in ml.predict(full[0], unl, categorical=["k"], medians=full[1]["medians"]).collect()}
    assert full[1]["rounds"] == info["m"]["rounds"] and len(alone) == 80
