"""Oracle SQL for the frame-operator queries."""

from __future__ import annotations

from ..functions.flight import PHASE_ORDER
from .o_features import FX_AIRCRAFT_EXTRA, FX_AIRCRAFT_FAA, TRAJ_SUMMARY, _FAA_J
from .oracle import ORACLE
from .q_frame import LI_NUM, LI_ORDER
from .sqltext import FX_AIRPORTS, FX_FLIGHTS, FX_FLIGHTS_FULL, phased_ctes, sig, with_

IDS = "ids AS (select flight_id, (flight_id*7919) % 100003 as pos from fx_flights where flight_id % 5 = 0)"

ORACLE["flights_with_traj"] = with_(FX_FLIGHTS) + \
    "select flight_id, aircraft_type from fx_flights where flight_id in (select user_id from events)"
ORACLE["flights_without_traj"] = with_(FX_FLIGHTS) + \
    "select flight_id, aircraft_type from fx_flights f where not exists (select 1 from events e where e.user_id = f.flight_id)"

ORACLE["reindex_to_ids"] = with_(*TRAJ_SUMMARY, IDS) + (
    f"select i.flight_id, i.pos, {sig('s.flown_distance_ENR')} as flown_distance_ENR, "
    f"{sig('s.max_altitude_ENR')} as max_altitude_ENR from ids i left join sfx s on i.flight_id = s.flight_id")

ORACLE["agreement_rate"] = with_(FX_FLIGHTS) + (
    f"select {sig('avg(case when flight_id % 7 = 0 then 0.0 when flight_id % 11 <> 0 or aircraft_type is null then 1.0 else 0.0 end)')} as agreement, "
    "count(*) as n from fx_flights")

ORACLE["histogram_given_edges"] = """WITH e AS (select * from (values (0, 1.0::double, 5.0::double), (1, 5.0, 10.0), (2, 10.0, 20.0), (3, 20.0, 40.0), (4, 40.0, 50.0)) t(bin, low, high))
select bin::int as bin, low, high, (select count(*) from lineitem where l_quantity >= low and (l_quantity < high or (bin = 4 and l_quantity = high))) as count from e"""

ORACLE["dedupe_rows"] = "select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag from lineitem"

ORACLE["dedupe_key_first"] = (
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from (select *, row_number() over "
    f"(partition by l_orderkey, l_linenumber order by {', '.join(LI_ORDER)}) as rn from lineitem) q where rn = 1")

ORACLE["set_ops"] = with_(FX_AIRPORTS, FX_FLIGHTS, """
used AS (select adep as icao from fx_flights union select ades from fx_flights)""") + """
select icao, 'used' as kind from used union all
select icao, 'missing' from (select icao from used except select icao from fx_airports) a union all
select icao, 'both' from (select icao from used intersect select icao from fx_airports) b"""

ORACLE["union_by_name"] = with_(FX_FLIGHTS, FX_FLIGHTS_FULL) + (
    f"select flight_id, {sig('tow')} as tow, 'train' as split from fx_flights_full where tow is not null union all "
    "select flight_id, null::double, 'test' from fx_flights_full where tow is null")

AIRCRAFT = [FX_FLIGHTS, FX_FLIGHTS_FULL, FX_AIRCRAFT_FAA, FX_AIRCRAFT_EXTRA, _FAA_J, """
af AS (select f.*, a.* exclude (aircraft_type), x.* exclude (aircraft_type),
  case when Physical_Class_Engine = 'Turboprop' and wtc = 'M' then 'Medium Turbo Prop'
   when Physical_Class_Engine = 'Jet' and wtc = 'M' then 'Medium Jet'
   when Physical_Class_Engine = 'Jet' and wtc = 'H' then 'Heavy Jet' end as Aircraft_Class
 from fx_flights_full f
 left join faaj a on f.aircraft_type = a.aircraft_type left join fx_aircraft_extra x on f.aircraft_type = x.aircraft_type)"""]

ORACLE["any_null_rows"] = with_(*AIRCRAFT) + \
    "select flight_id from af where Manufacturer is null or mzfw_kg is null or tow is null"

_AF_COLS = ["aircraft_type", "flight_id", "callsign", "adep", "ades", "actual_offblock_time", "arrival_time",
            "flight_duration", "taxiout_time", "flown_distance", "airline", "wtc", "tow", "country_code_adep",
            "country_code_ades", "Manufacturer", "Model_FAA", "Physical_Class_Engine", "Num_Engines",
            "Approach_Speed_knot", "FAA_Weight", "MTOW_kg", "MALW_kg", "Aircraft_Class", "mzfw_kg", "max_fuel_l",
            "seats_typ", "cargo_capacity", "range_km", "tas_knots", "wingspan_m", "length_m", "height_m",
            "oew_kg", "seats_min", "seats_max"]
ORACLE["missing_profile"] = with_(*AIRCRAFT) + 'select "column", missing, ' + sig("cast(missing as double)/n*100") + \
    " as percentage from (" + " union all ".join(
        f"select '{c}' as column, cast(count(*) - count({c}) as bigint) as missing, count(*) as n from af" for c in _AF_COLS) + \
    ") q where missing > 0"


def _describe_sql() -> str:
    parts = []
    for c in LI_NUM:
        parts.append(
            f"select '{c}' as column, count({c}) as count, {sig(f'avg({c})')} as mean, {sig(f'stddev_samp({c})')} as std, "
            f"{sig(f'min({c})')} as min, {sig(f'quantile_cont({c}, 0.25)')} as q25, {sig(f'quantile_cont({c}, 0.5)')} as q50, "
            f"{sig(f'quantile_cont({c}, 0.75)')} as q75, {sig(f'max({c})')} as max from lineitem")
    return " union all ".join(parts)


ORACLE["describe_lineitem"] = _describe_sql()

ORACLE["value_counts_wtc"] = with_(FX_FLIGHTS) + "select wtc, count(*) as count from fx_flights group by wtc"

ORACLE["nunique_part"] = " union all ".join(
    f"select '{c}' as column, count(distinct {c}) as nunique from part" for c in ["p_name", "p_brand", "p_type", "p_size"])


def _corr_sql(table: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"select '{a}' as a, '{b}' as b, {sig(f'corr({a}, {b})')} as r from {table}")
            parts.append(f"select '{b}' as a, '{a}' as b, {sig(f'corr({a}, {b})')} as r from {table}")
        parts.append(f"select '{a}' as a, '{a}' as b, 1.0::double as r")
    return " union all ".join(parts)


ORACLE["correlation_lineitem"] = _corr_sql("lineitem", LI_NUM)

_LC = LI_NUM + ["l_price2"]
ORACLE["correlated_drop"] = (
    "WITH li AS (select *, l_extendedprice*1.01::double + l_tax as l_price2 from lineitem), "
    "cr AS (" + " union all ".join(
        f"select '{b}' as column, corr({a}, {b}) as r from li" for i, a in enumerate(_LC) for b in _LC[i + 1:])
    + ') select distinct "column" from cr where abs(r) > 0.98')


def _box_sql() -> str:
    parts = []
    for c in LI_NUM:
        parts.append(f"""select '{c}' as column, {sig('q1')} as q1, {sig('med')} as median, {sig('q3')} as q3, {sig('q3 - q1')} as iqr,
 {sig(f'(select min({c}) from lineitem where {c} >= q1 - 1.5*(q3 - q1))')} as whisker_low,
 {sig(f'(select max({c}) from lineitem where {c} <= q3 + 1.5*(q3 - q1))')} as whisker_high,
 (select count(*) from lineitem where {c} < q1 - 1.5*(q3 - q1) or {c} > q3 + 1.5*(q3 - q1)) as outliers
 from (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as med, quantile_cont({c}, 0.75) as q3 from lineitem) q""")
    return " union all ".join(parts)


ORACLE["boxplot_lineitem"] = _box_sql()

ORACLE["histogram_price"] = """WITH r AS (select min(l_extendedprice) as lo, max(l_extendedprice) as hi, count(l_extendedprice) as n from lineitem),
w AS (select lo, n, (hi - lo)/200 as width from r),
c AS (select cast(least(floor((l_extendedprice - lo)/width), 199) as int) as bin, count(*) as cnt from lineitem, w
      where l_extendedprice is not null group by 1),
g AS (select cast(range as int) as bin from range(200))
select g.bin, """ + sig("lo + g.bin*width") + " as low, " + sig("lo + (g.bin + 1)*width") + \
    " as high, coalesce(cnt, 0) as count, " + sig("coalesce(cnt, 0)/(cast(n as double)*width)") + \
    " as density from g cross join w left join c on g.bin = c.bin"

_porder = ", ".join(f"'{p}'" for p in PHASE_ORDER)
ORACLE["sort_custom_order"] = with_(*phased_ctes()) + \
    f"select flight_id, event_id, phase, cast(list_position([{_porder}], phase) as int) as phase_rank from ph"

ORACLE["topk_lineitem"] = ("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem "
                           "order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey limit 20")

ORACLE["first_n_per_group"] = (
    "select l_orderkey, n, l_linenumber, l_partkey, l_suppkey from (select *, cast(row_number() over "
    f"(partition by l_orderkey order by l_linenumber, {', '.join(LI_ORDER)}) as int) as n from lineitem) q where n <= 3")
