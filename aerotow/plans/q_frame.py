"""Registered queries: frame operators (joins, reindex, dedupe, sets, profiles, statistics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.flight import PHASE_ORDER
from ..operators import frame as fr
from ..operators import tabular as tb
from ..operators import trajectory as tr
from ..operators.dims import dedupe_key_first
from ..sources import fixtures as fx
from .catalog import normalise, register

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus"]


def _events_ids(spark, sf):
    return fx.table(spark, sf, "events").select(F.col("user_id").alias("flight_id"))


@register("flights_with_traj")
def q_flights_with_traj(spark, sf):
    return fr.semi(fx.fx_flights(spark, sf), _events_ids(spark, sf), "flight_id").select("flight_id", "aircraft_type")


@register("flights_without_traj")
def q_flights_without_traj(spark, sf):
    return fr.anti(fx.fx_flights(spark, sf), _events_ids(spark, sf), "flight_id").select("flight_id", "aircraft_type")


def requested_ids(spark, sf):
    """The unlabelled flights in a fixed requested order (``pos``)."""
    f = fx.fx_flights(spark, sf).where(F.col("flight_id") % 5 == 0)
    return f.select("flight_id", ((F.col("flight_id") * 7919) % 100003).alias("pos"))


@register("reindex_to_ids")
def q_reindex_to_ids(spark, sf):
    p = tr.assign_phases(fx.fx_traj(spark, sf), fx.fx_flights(spark, sf), fx.fx_airports(spark, sf))
    s = tr.phase_summary(p).select("flight_id", "flown_distance_ENR", "max_altitude_ENR")
    return fr.reindex_to_ids(requested_ids(spark, sf), s, "flight_id").transform(normalise)


@register("agreement_rate")
def q_agreement_rate(spark, sf):
    f = fx.fx_flights(spark, sf)
    other = f.withColumn("aircraft_type", F.when(F.col("flight_id") % 7 == 0, F.lit("other")).when(
        F.col("flight_id") % 11 != 0, F.col("aircraft_type")))
    return fr.agreement_rate(f, other, "flight_id", "aircraft_type").transform(normalise)


@register("histogram_given_edges")
def q_histogram_given_edges(spark, sf):
    return fr.histogram_edges(fx.table(spark, sf, "lineitem"), "l_quantity", [1, 5, 10, 20, 40, 50])


@register("dedupe_rows")
def q_dedupe_rows(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return fr.dedupe_rows(li)


@register("dedupe_key_first")
def q_dedupe_key_first(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    d = dedupe_key_first(li, ["l_orderkey", "l_linenumber"], LI_ORDER)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@register("set_ops")
def q_set_ops(spark, sf):
    used = fr.distinct_values(fx.fx_flights(spark, sf), ["adep", "ades"], "icao")
    dim = fx.fx_airports(spark, sf).select("icao")
    return fr.union_by_name(used.withColumn("kind", F.lit("used")),
                            fr.set_diff(used, dim).withColumn("kind", F.lit("missing")),
                            fr.set_intersect(used, dim).withColumn("kind", F.lit("both")))


@register("union_by_name")
def q_union_by_name(spark, sf):
    f = fx.fx_flights_full(spark, sf)
    lab = f.where(F.col("tow").isNotNull()).select("flight_id", "tow")
    unl = f.where(F.col("tow").isNull()).select("flight_id")
    return fr.with_split_label(lab, unl).transform(normalise)


def _aircraft(spark, sf):
    return tb.join_aircraft(fx.fx_flights_full(spark, sf), fx.fx_aircraft_faa(spark, sf),
                            fx.fx_aircraft_extra(spark, sf))


@register("any_null_rows")
def q_any_null_rows(spark, sf):
    a = _aircraft(spark, sf).select("flight_id", "Manufacturer", "mzfw_kg", "tow")
    return fr.any_null_rows(a).select("flight_id")


@register("missing_profile")
def q_missing_profile(spark, sf):
    return fr.missing_profile(_aircraft(spark, sf)).transform(normalise)


@register("describe_lineitem")
def q_describe_lineitem(spark, sf):
    return fr.describe(fx.table(spark, sf, "lineitem"), LI_NUM).transform(normalise)


@register("value_counts_wtc")
def q_value_counts_wtc(spark, sf):
    return fr.value_counts(fx.fx_flights(spark, sf), "wtc")


@register("nunique_part")
def q_nunique_part(spark, sf):
    return fr.nunique(fx.table(spark, sf, "part"), ["p_name", "p_brand", "p_type", "p_size"])


@register("correlation_lineitem")
def q_correlation_lineitem(spark, sf):
    return fr.correlation_long(fx.table(spark, sf, "lineitem"), LI_NUM).transform(normalise)


def _li_correlated(spark, sf):
    return fx.table(spark, sf, "lineitem").withColumn(
        "l_price2", F.col("l_extendedprice") * 1.01 + F.col("l_tax"))


@register("correlated_drop")
def q_correlated_drop(spark, sf):
    cols = LI_NUM + ["l_price2"]
    return fr.correlated_drop(fr.correlation_long(_li_correlated(spark, sf), cols), cols)


@register("boxplot_lineitem")
def q_boxplot_lineitem(spark, sf):
    return fr.boxplot_stats(fx.table(spark, sf, "lineitem"), LI_NUM).transform(normalise)


@register("histogram_price")
def q_histogram_price(spark, sf):
    return fr.histogram(fx.table(spark, sf, "lineitem"), "l_extendedprice", 200, density=True).transform(normalise)


@register("sort_custom_order")
def q_sort_custom_order(spark, sf):
    p = tr.assign_phases(fx.fx_traj(spark, sf), fx.fx_flights(spark, sf), fx.fx_airports(spark, sf))
    p = fr.sort_by_custom_order(p, "phase", PHASE_ORDER, "phase_rank")
    return p.orderBy("flight_id", "timestamp", "phase_rank").select("flight_id", "event_id", "phase", "phase_rank")


@register("topk_lineitem")
def q_topk_lineitem(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return fr.topk(li, [F.col(o) if isinstance(o, str) else o for o in order], 20).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@register("first_n_per_group")
def q_first_n_per_group(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return fr.first_n_per_group(li, ["l_orderkey"], ["l_linenumber", *LI_ORDER], 3).select(
        "l_orderkey", "n", "l_linenumber", "l_partkey", "l_suppkey")
