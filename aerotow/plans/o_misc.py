"""Oracle SQL for the single-operator checks."""

from __future__ import annotations

from .oracle import ORACLE
from .sqltext import FX_FLIGHTS, div, finite_sql, fx_predictions_sql, phased_ctes, sig, with_

_PH = phased_ctes(sticky=False, short_route=False)

ORACLE["airport_fallback"] = with_(*_PH) + "select distinct flight_id, " + ", ".join(
    f"{sig(c)} as {c}" for c in ["adep_lon", "adep_lat", "ades_lon", "ades_lat"]) + " from p2"

ORACLE["climb_rate"] = with_(*_PH) + f"select flight_id, event_id, {sig('vertical_rate')} as vertical_rate from p0"

ORACLE["inf_to_null"] = (
    f"select l_orderkey, l_linenumber, l_partkey, {sig(finite_sql(div('l_tax', 'l_discount')))} as tax_per_discount, "
    f"{sig('case when abs(l_extendedprice*1e6) <= 5e10 then l_extendedprice*1e6 end')} as masked from lineitem")

ORACLE["parse_timestamp"] = (
    "select o_orderkey, strftime(ts, '%Y-%m-%d') as day from (select o_orderkey, "
    "try_cast(case when o_orderkey % 17 = 0 then 'not a date' else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end "
    "as timestamp) as ts from orders) q where ts is not null")

ORACLE["trajectory_features_hot"] = ORACLE["trajectory_features"]

ORACLE["model_roundtrip"] = with_(FX_FLIGHTS) + "select flight_id, true as same from fx_flights"

ORACLE["metrics_log"] = with_(FX_FLIGHTS, fx_predictions_sql(), """
m AS (select sqrt(avg((m_a - tow) * (m_a - tow))) as rmse,
  1 - sum((m_a - tow) * (m_a - tow)) / (sum(tow * tow) - sum(tow) * sum(tow) / count(*)) as r2
 from fx_predictions where tow is not null and m_a is not null)""") + (
    f"select 'run-a' as run, 'rmse' as metric, {sig('rmse')} as value from m union all "
    f"select 'run-a', 'r2', {sig('r2')} from m union all select 'run-b', 'rmse', {sig('rmse')} from m")
