"""Oracle SQL for imputation, encoding, scaling and ordered-fill queries."""

from __future__ import annotations

from .o_frame import AIRCRAFT, _AF_COLS
from .oracle import ORACLE
from .q_encode import AF_CAT, AF_NUM, LI_NUM
from .sqltext import FX_FLIGHTS, FX_FLIGHTS_FULL, sig, with_

ORACLE["impute_median"] = with_(*AIRCRAFT) + "select flight_id, " + ", ".join(
    f"{sig(f'coalesce({c}, (select median({c}) from af))')} as {c}" for c in AF_NUM) + " from af"

ORACLE["impute_mean_train"] = with_(*AIRCRAFT) + "select flight_id, " + ", ".join(
    f"{sig(f'coalesce({c}, (select avg({c}) from af where flight_id % 10 < 8))')} as {c}" for c in AF_NUM) + " from af"

ORACLE["impute_with_indicator"] = with_(*AIRCRAFT) + "select flight_id, " + ", ".join(
    f"{sig(f'coalesce({c}, (select median({c}) from af))')} as {c}" for c in ["mzfw_kg", "tow"]) + \
    ", mzfw_kg is null as mzfw_kg_na, tow is null as tow_na from af"

ORACLE["sparse_columns"] = with_(*AIRCRAFT) + " union all ".join(
    f"select '{c}' as \"column\" from af having count({c}) < floor(0.7 * count(*))" for c in _AF_COLS)

ORACLE["label_encode"] = with_(*AIRCRAFT) + "select flight_id, " + ", ".join(
    [f"cast({c} is not null as int) as {c}__present" for c in AF_CAT]
    + [f"cast(dense_rank() over (order by coalesce(cast({c} as varchar), 'MissingValue')) - 1 as int) as {c}_code"
       for c in AF_CAT]) + " from af"

ORACLE["category_align"] = with_(FX_FLIGHTS, """
tr AS (select * from fx_flights where cast(substr(aircraft_type, 2, 3) as int) < 25)""", """
ct AS (select aircraft_type, cast(row_number() over (order by aircraft_type) - 1 as int) as code from (select distinct aircraft_type from tr) q)""", """
ca AS (select airline, cast(row_number() over (order by airline) - 1 as int) as code from (select distinct airline from tr) q)""") + \
    """select f.flight_id, ct.code as aircraft_type_code, ca.code as airline_code from fx_flights f
 left join ct on f.aircraft_type = ct.aircraft_type left join ca on f.airline = ca.airline"""

# Categories of the fixture: wtc {H, M}; airline = the five TPC-H market segments.
_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_dummies = ", ".join(f"cast(coalesce(airline = '{s}', false) as int) as airline_{s}" for s in _SEG[1:])
_gates = [f"G{i}" for i in (2, 3, 4, 6, 7, 8, 9)]
_train = ", ".join(f"cast(flight_id % 10 = {g[1]} as int) as gate_{g}" for g in _gates)
_test = ", ".join(f"0 as gate_{g}" for g in _gates)
ORACLE["one_hot_align"] = with_(FX_FLIGHTS, FX_FLIGHTS_FULL) + (
    f"select flight_id, cast(coalesce(wtc = 'M', false) as int) as wtc_M, {_dummies}, {_train}, 'train' as split "
    "from fx_flights_full where tow is not null union all "
    f"select flight_id, cast(coalesce(wtc = 'M', false) as int) as wtc_M, {_dummies}, {_test}, 'test' from fx_flights_full where tow is null")

_std = ", ".join(
    f"{sig(f'({c} - (select avg({c}) from lineitem where l_orderkey % 10 < 9)) / greatest((select stddev_pop({c}) from lineitem where l_orderkey % 10 < 9), 1e-6)')} as {c}"
    for c in LI_NUM)
ORACLE["standardize_train"] = f"select l_orderkey, l_linenumber, l_partkey, {_std} from lineitem"

ORACLE["target_minmax"] = with_(FX_FLIGHTS, FX_FLIGHTS_FULL, """
mm AS (select min(tow)*0.95::double as lo, max(tow)*1.05::double as hi from fx_flights_full where tow is not null)""",
    "sc AS (select flight_id, tow, (tow - lo)/(hi - lo) as tow_scaled, lo, hi from fx_flights_full, mm)") + \
    f"select flight_id, {sig('tow')} as tow, {sig('tow_scaled')} as tow_scaled, {sig('tow_scaled*(hi - lo) + lo')} as tow_back from sc"

GAPPY = "og AS (select o_orderkey, case when o_orderkey % 7 <> 0 then o_totalprice end as v from orders)"
ORACLE["running_mean_table"] = with_(GAPPY) + \
    f"select o_orderkey, {sig('v')} as v, {sig('avg(v) over (order by o_orderkey rows between unbounded preceding and current row)')} as mean_v from og"
ORACLE["ffill_table"] = with_(GAPPY) + \
    f"select o_orderkey, {sig('last_value(v ignore nulls) over (order by o_orderkey rows between unbounded preceding and current row)')} as v from og"
ORACLE["clean_fill"] = with_("""c0 AS (select o_orderkey, case when o_orderkey % 11 = 0 then o_totalprice*1e12
  when o_orderkey % 13 = 0 then null else o_totalprice end as x from orders)""",
    "c1 AS (select o_orderkey, case when abs(x) <= 1e10 then x end as x from c0)",
    "md AS (select median(x) as mx from c1)") + \
    f"select o_orderkey, {sig('coalesce(last_value(x ignore nulls) over (order by o_orderkey rows between unbounded preceding and current row), mx)')} as x from c1, md"


ORACLE["split_holdout"] = with_(FX_FLIGHTS) + \
    "select count(*) as n, count(*) as n_split, true as share_ok, true as same from fx_flights"
ORACLE["sample_rows"] = "select least(count(*), 1000) as n, least(count(*), 1000) as n_found, 0 as n_other from lineitem"
ORACLE["noise_mask_swap"] = "select count(*) as n, true as masked_ok, true as swapped_ok, true as rest_same, 0 as strangers from orders"

_PC = ["wtc", "airline", "FAA_Weight"]
_PN = ["MTOW_kg", "MALW_kg", "Approach_Speed_knot", "mzfw_kg"]
ORACLE["prepare_tabular"] = with_(*AIRCRAFT, *[
    f"k{i} AS (select v, cast(row_number() over (order by v) - 1 as int) as code from "
    f"(select distinct coalesce(cast({c} as varchar), 'MissingValue') as v from af where flight_id % 10 < 8) q)" for i, c in enumerate(_PC)],
    "mn AS (select " + ", ".join(f"avg({c}) as m_{c}" for c in _PN) + ", min(tow) as lo, max(tow) as hi from af where flight_id % 10 < 8)",
    "fl AS (select flight_id, tow, " + ", ".join(f"coalesce(cast({c} as varchar), 'MissingValue') as {c}" for c in _PC)
    + ", cast(mzfw_kg is not null as int) as present, " + ", ".join(f"coalesce({c}, m_{c}) as {c}" for c in _PN) + " from af, mn)",
    "st AS (select " + ", ".join(f"avg({c}) as a_{c}, greatest(stddev_pop({c}), 1e-6) as s_{c}" for c in _PN)
    + " from fl where flight_id % 10 < 8)") + \
    "select flight_id, " + ", ".join(f"k{i}.code as {c}_code" for i, c in enumerate(_PC)) + ", present as mzfw_kg__present, " + \
    ", ".join(f"round(({c} - a_{c}) / s_{c}, 6) + 0.0 as {c}" for c in _PN) + f", round((tow - lo) / (hi - lo), 6) + 0.0 as tow_scaled from fl" + \
    "".join(f" left join k{i} on fl.{c} = k{i}.v" for i, c in enumerate(_PC)) + " cross join st cross join mn"
