"""Oracle SQL for blend, metrics and submission queries.

The blend oracle enumerates the same 3^k active sets in SQL and solves each
reduced system by Cramer's rule (k = 3).
"""

from __future__ import annotations

import itertools

from ..sources.fixtures import PREDICTION_MODELS
from .o_features import FX_AIRCRAFT_FAA, _FAA_J
from .oracle import ORACLE
from .sqltext import FX_FLIGHTS, fx_predictions_sql, sig, with_

MODELS = list(PREDICTION_MODELS)
K = len(MODELS)


def _g(i: int, j: int) -> str:
    return f"g{min(i, j)}{max(i, j)}"


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return f"({m[0][0]}*{m[1][1]} - {m[0][1]}*{m[1][0]})"
    terms = []
    for j in range(len(m)):
        minor = [row[:j] + row[j + 1:] for row in m[1:]]
        sign = "+" if j % 2 == 0 else "-"
        terms.append(f"{sign} {m[0][j]}*{_det(minor)}")
    return "(" + " ".join(terms) + ")"


def _candidates() -> list[str]:
    out = []
    for state in itertools.product((0, 1, 2), repeat=K):
        w = ["0.0::double" if s == 0 else "1.0::double" if s == 1 else None for s in state]
        free = [i for i, s in enumerate(state) if s == 2]
        fixed = [i for i, s in enumerate(state) if s != 2]
        if free:
            r = {i: "(b%d%s)" % (i, "".join(f" - {_g(i, j)}*{w[j]}" for j in fixed)) for i in free}
            a = [[_g(i, j) for j in free] for i in free]
            det = _det(a)
            for col, i in enumerate(free):
                mi = [[r[free[row]] if c == col else a[row][c] for c in range(len(free))] for row in range(len(free))]
                w[i] = f"({_det(mi)} / nullif({det}, 0))"
        out.append("select " + ", ".join(f"{w[i]} as w{i}" for i in range(K)) + " from gm")
    return out


_obj = " + ".join(f"w{i}*w{j}*{_g(i, j)}" for i in range(K) for j in range(K)) + " - 2*(" + \
    " + ".join(f"b{i}*w{i}" for i in range(K)) + ") + c"
_feasible = " and ".join(f"w{i} >= -1e-9 and w{i} <= 1 + 1e-9" for i in range(K))
_ok = " and ".join(f"{m} is not null" for m in MODELS)

BLEND_CTES = [FX_FLIGHTS, fx_predictions_sql(),
              "gm AS (select " + ", ".join(
                  [f"sum({MODELS[i]}*{MODELS[j]}) as g{i}{j}" for i in range(K) for j in range(i, K)]
                  + [f"sum({MODELS[i]}*tow) as b{i}" for i in range(K)] + ["sum(tow*tow) as c"])
              + f" from fx_predictions where tow is not null and {_ok})",
              "cand AS (" + " union all ".join(_candidates()) + ")",
              f"bw AS (select {', '.join(f'greatest(least(w{i}, 1.0), 0.0) as w{i}' for i in range(K))} "
              f"from cand, gm where {_feasible} order by {_obj} limit 1)"]

ORACLE["blend_weights"] = with_(*BLEND_CTES) + "select " + ", ".join(
    f"{sig(f'w{i}', 20)} as w_{m}" for i, m in enumerate(MODELS)) + " from bw"

_blended = " + ".join(f"{m}*w{i}" for i, m in enumerate(MODELS))
ORACLE["blend_apply"] = with_(*BLEND_CTES) + \
    f"select flight_id, {sig(_blended, 20)} as tow from fx_predictions, bw where {_ok}"

ORACLE["submission"] = with_(*BLEND_CTES, """
ids AS (select flight_id, (flight_id*7919) % 100003 as pos from fx_flights where flight_id % 5 = 0)""",
                             f"bl AS (select flight_id, {_blended} as tow from fx_predictions, bw where {_ok})") + \
    f"select i.flight_id, i.pos, {sig('bl.tow', 20)} as tow from ids i left join bl on i.flight_id = bl.flight_id"


def _metrics_select(pred: str) -> str:
    e = f"({pred} - tow)"
    return (f"count(*) as n, {sig(f'sqrt(avg({e}*{e}))')} as rmse, {sig(f'avg({e})')} as bias, "
            f"{sig(f'stddev_pop({e})')} as error_std, "
            f"{sig(f'avg(greatest(-5000.0, least(5000.0, {e})))')} as clipped_error_mean, "
            f"{sig(f'1.0 - sum({e}*{e}) / (sum(tow*tow) - sum(tow)*sum(tow)/count(*))')} as r2")


ORACLE["regression_metrics"] = with_(FX_FLIGHTS, fx_predictions_sql()) + \
    f"select {_metrics_select('m_a')} from fx_predictions where tow is not null and m_a is not null"

ORACLE["group_rmse"] = with_(FX_FLIGHTS, fx_predictions_sql(), FX_AIRCRAFT_FAA, _FAA_J, """
gc AS (select f.flight_id, case when Physical_Class_Engine = 'Turboprop' and wtc = 'M' then 'Medium Turbo Prop'
   when Physical_Class_Engine = 'Jet' and wtc = 'M' then 'Medium Jet'
   when Physical_Class_Engine = 'Jet' and wtc = 'H' then 'Heavy Jet' end as Aircraft_Class
 from fx_flights f left join faaj a on f.aircraft_type = a.aircraft_type)""",
    "gp AS (select p.*, gc.Aircraft_Class from fx_predictions p join gc on p.flight_id = gc.flight_id)") + \
    f"select Aircraft_Class, {_metrics_select('m_b')} from gp where tow is not null and m_b is not null group by Aircraft_Class"

ORACLE["classification_metrics"] = with_(
    "sl AS (select doc_id, quality, cast((doc_id*37) % 100 as double)/100*0.7 + quality*0.25 as score from labels "
    "where quality is not null)",
    "rk AS (select quality, score, rank() over (order by score) + (count(*) over (partition by score) - 1)/2.0 as ar from sl)",
    "ag AS (select sum(case when quality = 1 then ar else 0 end) as rs, sum(quality) as np, count(*) as n from rk)") + \
    f"select {sig('(select avg(cast(cast(score >= 0.5 as int) = quality as double)) from sl)')} as accuracy, " + \
    sig("(rs - np*(np + 1)/2.0) / (np*(n - np))") + " as auc, n from ag"
