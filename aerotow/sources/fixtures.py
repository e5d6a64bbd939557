"""Stand-in inputs derived from the driver tables.

The reference reads private flight lists, trajectory files and reference
tables.  The builders below derive tables of the same shape from the driver's
TPC-H-like tables so that every operator runs on data whose volume grows with
the scale factor.  The definitions are the ones written down in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table

# Country code of airport ``A<n>`` is COUNTRY_BY_DIGIT[n % 10].
COUNTRY_BY_DIGIT = ["GB", "FR", "US", "BR", "JP", "AE", "ZA", "AU", "ZZ", "DE"]

# The three synthetic model predictions, (c, k) in
# tow * (1 + c * (((flight_id * k) % 101) - 50) / 1000).
PREDICTION_MODELS = {"m_a": (1.0, 7), "m_b": (2.0, 13), "m_c": (0.5, 29)}


def _minutes(ts: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes.cast("int"), ts)


def fx_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 9 != 0)
    k = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("A"), k.cast("string")).alias("icao"),
        (((k * 7) % 120).cast("double") - 60).alias("lat"),
        (((k * 13) % 360).cast("double") - 180).alias("lon"),
        ((k * 31) % 900).cast("double").alias("altitude"),
    )


def fx_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    off = (ok * 37) % 1440
    dur = (ok * 53) % 600
    taxi = ok % 31
    return o.join(c, o.o_custkey == c.c_custkey).select(
        ok.alias("flight_id"),
        F.concat(F.lit("C"), ck.cast("string")).alias("callsign"),
        F.concat(F.lit("A"), (ok % 100).cast("string")).alias("adep"),
        F.concat(F.lit("A"), ((ok + 1 + ck % 3) % 100).cast("string")).alias("ades"),
        _minutes(F.col("o_orderdate"), off).alias("actual_offblock_time"),
        _minutes(F.col("o_orderdate"), off + dur + taxi).alias("arrival_time"),
        dur.cast("double").alias("flight_duration"),
        taxi.cast("double").alias("taxiout_time"),
        (F.col("o_totalprice") / 100).alias("flown_distance"),
        F.col("c_mktsegment").alias("airline"),
        F.when(ok % 4 == 0, "H").otherwise("M").alias("wtc"),
        F.concat(F.lit("T"), (ck % 30).cast("string")).alias("aircraft_type"),
        F.col("o_totalprice").alias("tow"),
    )


def fx_traj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectory points: one row per event, flight = user.

    The position eases from the departure to the arrival airport.  The window
    here only builds the test input (row number and count per user); the
    operators themselves never depend on it.
    """
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = (e.withColumn("rn", F.row_number().over(w))
          .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
          .withColumn("x", (F.col("rn") - 1).cast("double") / (F.col("n") - 1)))
    f = fx_flights(spark, sf_dir).select("flight_id", "adep", "ades")
    a = fx_airports(spark, sf_dir)
    dep = a.select(F.col("icao").alias("adep"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    arr = a.select(F.col("icao").alias("ades"), F.col("lat").alias("lb"), F.col("lon").alias("lp"))
    g = (f.join(dep, "adep", "left").join(arr, "ades", "left")
          .select("flight_id",
                  F.coalesce("la", F.lit(10.0)).alias("la"), F.coalesce("lo", F.lit(20.0)).alias("lo"),
                  F.coalesce("lb", F.lit(13.0)).alias("lb"), F.coalesce("lp", F.lit(24.0)).alias("lp")))
    x = F.col("x")
    ease = x * x * x * (10 - 15 * x + 6 * x * x)
    rn, n, v, eid = F.col("rn"), F.col("n"), F.col("value"), F.col("event_id")
    level = F.least(rn - 1, n - rn, F.lit(12))
    return e.join(g, e.user_id == g.flight_id).select(
        F.col("user_id").alias("flight_id"),
        eid,
        F.col("ts").alias("timestamp"),
        (F.col("la") + (F.col("lb") - F.col("la")) * ease).alias("latitude"),
        (F.col("lo") + (F.col("lp") - F.col("lo")) * ease).alias("longitude"),
        F.when(eid % 13 == 0, F.lit(None).cast("double"))
         .otherwise(level.cast("double") * 3000 + v).alias("altitude"),
        F.when(eid % 7 == 0, F.lit(None).cast("double"))
         .when(eid % 5 == 0, F.lit(100.0))
         .when(rn <= 12, 1500.0 + v)
         .when(n - rn < 12, -1500.0 - v)
         .otherwise(v - 50).alias("vertical_rate"),
        (250.0 + v).alias("groundspeed"),
        ((eid * 37) % 360).cast("double").alias("track"),
        ((eid % 21).cast("double") - 10).alias("u_component_of_wind"),
        ((eid % 17).cast("double") - 8).alias("v_component_of_wind"),
        (F.lit(288.15) - level * F.lit(5.9436)).alias("temperature"),
        (v / 10000).alias("specific_humidity"),
    )


def fx_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase labels that revert often (used to exercise sticky phases)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("flight_id"), "event_id",
                    F.col("ts").alias("timestamp"), F.col("event_type").alias("phase"))


def country_of(icao: Column) -> Column:
    """Country code of a fixture airport (``A<n>`` -> COUNTRY_BY_DIGIT[n % 10])."""
    digit = (F.substring(icao, 2, 12).cast("long") % 10).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in COUNTRY_BY_DIGIT]), digit + 1)


def fx_flights_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights with country codes and the labelled/unlabelled split.

    Every fifth flight is unlabelled (``tow`` null), the others labelled.
    """
    f = fx_flights(spark, sf_dir)
    return (f.withColumn("country_code_adep", country_of(F.col("adep")))
             .withColumn("country_code_ades", country_of(F.col("ades")))
             .withColumn("tow", F.when(F.col("flight_id") % 5 != 0, F.col("tow"))))


def fx_aircraft_faa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FAA-like aircraft table: one row per distinct type, 1 in 7 types left out."""
    t = fx_flights(spark, sf_dir).select("aircraft_type").distinct()
    n = F.substring("aircraft_type", 2, 6).cast("int")
    return (t.where(n % 7 != 6).select(
        F.col("aircraft_type").alias("FAA_Designator"),
        (F.lit(1000.0) * (n + 100)).alias("MTOW_lb"),
        (F.lit(900.0) * (n + 100)).alias("MALW_lb"),
        F.concat(F.lit("M"), (n % 4).cast("string")).alias("Manufacturer"),
        F.concat(F.lit("Model"), n.cast("string")).alias("Model_FAA"),
        F.when(n % 2 == 0, "Jet").otherwise("Turboprop").alias("Physical_Class_Engine"),
        F.concat(F.lit("W"), (n % 3).cast("string")).alias("FAA_Weight"),
        (2 + (n % 2) * 2).cast("int").alias("Num_Engines"),
        (F.lit(120.0) + n).alias("Approach_Speed_knot"),
    ))


def fx_aircraft_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aircraft extra table: 12 numeric columns for every third type."""
    t = fx_flights(spark, sf_dir).select("aircraft_type").distinct()
    n = F.substring("aircraft_type", 2, 6).cast("double")
    return t.where(n % 3 != 2).select(
        "aircraft_type",
        (n * 1000 + 40000).alias("mzfw_kg"), (n * 500 + 20000).alias("max_fuel_l"),
        (n * 5 + 100).alias("seats_typ"), (n * 2 + 10).alias("cargo_capacity"),
        (n * 100 + 3000).alias("range_km"), (n + 400).alias("tas_knots"),
        (n * 0.5 + 30).alias("wingspan_m"), (n * 0.7 + 30).alias("length_m"),
        (n * 0.1 + 10).alias("height_m"), (n * 800 + 30000).alias("oew_kg"),
        (n * 4 + 80).alias("seats_min"), (n * 6 + 120).alias("seats_max"),
    )


def fx_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three synthetic model predictions for every flight with a price."""
    f = fx_flights(spark, sf_dir).select("flight_id", "tow")
    cols = [F.col("flight_id"), F.col("tow")]
    for name, (c, k) in PREDICTION_MODELS.items():
        noise = ((F.col("flight_id") * k) % 101 - 50).cast("double")
        cols.append((F.col("tow") * (F.lit(1.0) + F.lit(c) * noise / 1000)).alias(name))
    return f.select(*cols)


# Hand-entered airport rows (icao, lat, lon, altitude) patched in
# after the two file sources, as the reference does for codes both files miss.
PATCH_AIRPORTS = [("A0", 1.0, 2.0, 3.0), ("A9", 4.5, 5.5, 66.0), ("A12", 0.0, 0.0, 0.0)]


def fx_airports_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second airport source: overlaps the first on every fourth code."""
    s = table(spark, sf_dir, "supplier").where((F.col("s_suppkey") % 9 == 0) | (F.col("s_suppkey") % 4 == 0))
    k = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("A"), k.cast("string")).alias("icao"),
        (((k * 7) % 120).cast("double") - 60 + 0.5).alias("lat"),
        (((k * 13) % 360).cast("double") - 180 - 0.5).alias("lon"),
        (((k * 31) % 900).cast("double") + 10).alias("altitude"),
        k.alias("line"),
    )


def patch_airports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATCH_AIRPORTS, "icao string, lat double, lon double, altitude double")
