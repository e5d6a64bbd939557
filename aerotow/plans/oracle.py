"""DuckDB reference SQL for the registered queries (see ``catalog``)."""

from __future__ import annotations

from ..operators.trajectory import (DROPPED_PIVOT, N_SAMPLES, SAMPLE_MEASURES, SUM_FEATURES,
                                    SUMMARY_FEATURES)
from ..functions.flight import SUMMARY_PHASES
from .sqltext import (FX_PHASE, W_FLIGHT, energy, epoch_s, hav_m, phased_ctes, sig, tas, tail,
                      with_)

ORACLE: dict[str, str] = {}

ORD = '"timestamp", event_id'


def sticky_ctes(src: str, pairs, col: str = "phase", prefix: str = "st") -> tuple[list[str], str]:
    ctes, last = [], src
    for i, (frm, to) in enumerate(pairs):
        ctes.append(f"""{prefix}h{i} AS (select *, cast(coalesce(lag({col}) over w = '{to}' and {col} = '{frm}', false) as int) as hit
 from {last} window w as ({W_FLIGHT}))""")
        ctes.append(f"""{prefix}s{i} AS (select * exclude (hit) replace (case when {col} = '{frm}' and max(hit) over wr > 0 then '{to}' else {col} end as {col})
 from {prefix}h{i} window wr as ({W_FLIGHT} rows between unbounded preceding and current row))""")
        last = f"{prefix}s{i}"
    return ctes, last


# ----------------------------------------------------------------- trajectory

ORACLE["traj_phase_counts"] = with_(*phased_ctes()) + f"""
select flight_id, phase, count(*) as n_points, {sig('sum(dist_adep)')} as sum_dist_adep,
 {sig('sum(vertical_rate)')} as sum_vertical_rate from ph group by flight_id, phase"""

ORACLE["traj_phase_initial"] = with_(*phased_ctes(sticky=False, short_route=False)) + """
select phase, count(*) as n_points from ph group by phase"""

_c, _last = sticky_ctes("fx_phase", [("view", "click"), ("signup", "purchase")])
ORACLE["sticky_phase"] = with_(FX_PHASE, *_c) + f"select flight_id, event_id, phase from {_last}"

_MEAS = {"average_vertical_rate": "vertical_rate", "average_airspeed": "airspeed",
         "groundspeed": "gs_ms", "average_temperature": "temperature",
         "average_humidity": "specific_humidity", "average_altitude": "altitude"}


def _summary_ctes() -> list[str]:
    ranks = ",\n  ".join(
        f"case when {m} is not null then row_number() over (partition by flight_id, sp order by {m} nulls last) end as r_{o},"
        f" count({m}) over (partition by flight_id, sp) as n_{o}" for o, m in _MEAS.items())
    tmeans = ",\n  ".join(
        f"avg({m}) filter (where r_{o} > floor(n_{o}*0.05) and r_{o} <= n_{o} - floor(n_{o}*0.05)) as {o}"
        for o, m in _MEAS.items())
    return [
        """sm AS (select *, case phase when 'DEP_100' then 'ENR' when 'ARR_40' then 'ARR_100' else phase end as sp
 from ph where phase in ('DEP_40','DEP_100','ENR','ARR_100','ARR_40'))""",
        f"""sx AS (select *, {hav_m('longitude','latitude','lag(longitude) over w2','lag(latitude) over w2')} as step_m,
  {epoch_s('"timestamp"')} - {epoch_s('lag("timestamp") over w2')} as timelag, radians(track) as track_rad,
  groundspeed*0.514444::double as gs_ms, {tas()} as airspeed, {energy(tas())} as specific_energy, {tail()} as tailwind_speed
 from sm window w2 as (partition by flight_id, sp order by {ORD}))""",
        f"""sr AS (select *, tailwind_speed*timelag as wind_distance,
  {ranks} from sx)""",
        f"""sagg AS (select flight_id, sp as phase,
  least(abs(max(track_rad)-min(track_rad)), abs(max(track_rad)-(min(track_rad)+360))) as track_variation,
  {tmeans},
  coalesce(sum(wind_distance), 0.0) as wind_distance, last(specific_energy order by {ORD}) as specific_energy,
  coalesce(sum(step_m), 0.0) as flown_distance, max(altitude) as max_altitude,
  quantile_cont(altitude, 0.99) as cruise_altitude
 from sr group by flight_id, sp)""",
    ]


def _summary_select() -> str:
    cols = []
    for f in SUMMARY_FEATURES:
        for p in SUMMARY_PHASES:
            n = f"{f}_{p}"
            if n in DROPPED_PIVOT:
                continue
            v = f"max(case when phase = '{p}' then {f} end)"
            if f in SUM_FEATURES:
                v = f"coalesce({v}, 0.0)"
            cols.append(f"{v} as {n}")
    return ("swide AS (select flight_id, " + ",\n ".join(cols) + " from sagg group by flight_id)")


def _summary_cols() -> list[str]:
    return [f"{f}_{p}" for f in SUMMARY_FEATURES for p in SUMMARY_PHASES
            if f"{f}_{p}" not in DROPPED_PIVOT]


def _coalesce0(name: str) -> str:
    return f"coalesce({name}, 0.0)" if any(name == f"{f}_{p}" for f in SUM_FEATURES
                                           for p in SUMMARY_PHASES) else name


SUMMARY_CTES = _summary_ctes() + [_summary_select(), """sfl AS (select fl.flight_id, sw.* exclude (flight_id)
 from (select distinct flight_id from ph) fl left join swide sw on fl.flight_id = sw.flight_id)"""]

ORACLE["phase_summary"] = with_(*phased_ctes(), *SUMMARY_CTES) + "select flight_id, " + ", ".join(
    f"{sig(_coalesce0(c))} as {c}" for c in _summary_cols()) + " from sfl"

ORACLE["track_variation_circular"] = with_(*phased_ctes(), *_summary_ctes()[:1], """tv AS (select flight_id, sp as phase,
  max(radians(track)) as hi, min(radians(track)) as lo from sm group by flight_id, sp)""") + \
    f"select flight_id, phase, {sig('least(abs(hi - lo), abs(hi - (lo + 2 * pi())))')} as track_variation from tv"

ENERGY_CTES = [
    "e0 AS (select * from ph where phase = 'DEP_40' and vertical_rate > 0)",
    f"""e1 AS (select *, first_value(dist_adep) over (partition by flight_id order by {ORD}
   rows between unbounded preceding and unbounded following) as fd from e0)""",
    f"""e2 AS (select *, coalesce({hav_m('longitude','latitude','lag(longitude) over w','lag(latitude) over w')}, 0.0) as st
 from e1 where fd < 2 window w as ({W_FLIGHT}))""",
    f"""e3 AS (select *, sum(st) over (partition by flight_id order by {ORD} rows between unbounded preceding and current row)*5.39957e-4 as cum from e2)""",
    f"e4 AS (select *, {tas()} as airspeed, {energy(tas())} as se from e3 where cum <= 10)",
    f"""energy AS (select flight_id, last(se order by cum, {ORD}) as specific_energy,
  last(airspeed order by cum, {ORD}) as tas_10NM, last(groundspeed order by cum, {ORD}) as groundspeed_10NM
 from e4 group by flight_id)""",
]
ENERGY_COLS = ["specific_energy", "tas_10NM", "groundspeed_10NM"]

ORACLE["energy_10nm"] = with_(*phased_ctes(), *ENERGY_CTES) + "select flight_id, " + ", ".join(
    f"{sig(c)} as {c}" for c in ENERGY_COLS) + " from energy"

LIFT_CTES = [
    "l0 AS (select *, altitude - adep_altitude as adep_height from ph where dist_adep < 2)",
    f"l1 AS (select *, {tas()} as airspeed from l0 where adep_height > 0)",
    f"""lift AS (select flight_id, first(adep_height order by {ORD}) as first_adep_height,
  first(airspeed order by {ORD}) as vlof_tas, pow(first(airspeed order by {ORD}), 2) as sqrd_vlof_tas,
  first(groundspeed order by {ORD}) as vlof_groundspeed from l1 group by flight_id)""",
]
LIFT_COLS = ["first_adep_height", "vlof_tas", "sqrd_vlof_tas", "vlof_groundspeed"]

ORACLE["liftoff"] = with_(*phased_ctes(), *LIFT_CTES) + "select flight_id, " + ", ".join(
    f"{sig(c)} as {c}" for c in LIFT_COLS) + " from lift"

SAMPLE_COLS = [f"{m}_{k}" for m in SAMPLE_MEASURES for k in range(1, N_SAMPLES + 1)]
SAMPLE_CTES = [
    f"c0 AS (select *, row_number() over (partition by flight_id order by {ORD}) as n from l1)",
    f"c1 AS (select *, airspeed as tas, pow(airspeed, 2) as sqrd_tas, {energy('airspeed')} as specific_energy from c0 where n <= {N_SAMPLES})",
    "samples AS (select flight_id, " + ", ".join(
        f"max(case when n = {k} then {m} end) as {m}_{k}" for m in SAMPLE_MEASURES
        for k in range(1, N_SAMPLES + 1)) + " from c1 group by flight_id)",
]

ORACLE["climb_samples"] = with_(*phased_ctes(), *LIFT_CTES, *SAMPLE_CTES) + "select flight_id, " + ", ".join(
    f"{sig(c)} as {c}" for c in SAMPLE_COLS) + " from samples"


def _before_top(src: str, p: str) -> list[str]:
    return [
        f"""{p}1 AS (select *, round_even(altitude, -2) as alt2, {epoch_s('"timestamp"')} as time,
  row_number() over (partition by flight_id order by {ORD}) as rn from {src})""",
        f"{p}2 AS (select *, max(alt2) over (partition by flight_id) as altmax from {p}1)",
        f"{p}3 AS (select *, min(case when alt2 = altmax then rn end) over (partition by flight_id) as position from {p}2)",
        f"{p}4 AS (select * from {p}3 where rn < position)",
    ]


LEVEL_TIME = f"coalesce(case when abs(vertical_rate) < 300 then lead(time) over (partition by flight_id order by {ORD}) - time else 0.0 end, 0.0)"

FLAG_CTES = [
    "b0 AS (select *, altitude - adep_altitude as adep_height from ph where dist_adep < 200 and altitude - adep_altitude > 0)",
    *_before_top("b0", "b"),
    "f0 AS (select *, altmax*0.99::double as altlimit2 from b4 where altitude > altmax*0.99::double)",
    f"f1 AS (select *, {LEVEL_TIME} as leveltime from f0)",
    "flags AS (select flight_id, first(altlimit2) as altlimit2, 1 as box_flag from f1 group by flight_id having sum(leveltime) > 0)",
]

ORACLE["level_flight_flag"] = with_(*phased_ctes(), *FLAG_CTES) + \
    f"select flight_id, {sig('altlimit2')} as altlimit2, box_flag from flags"

KPI_CTES = [
    "k0 AS (select b0.*, fl.altlimit2, fl.box_flag from b0 left join flags fl on b0.flight_id = fl.flight_id)",
    *_before_top("k0", "k"),
    "k5 AS (select * from k4 where altitude < case when coalesce(box_flag, 0) = 1 then altlimit2 else altmax end)",
    f"""k6 AS (select *, {LEVEL_TIME} as leveltime,
  {hav_m('longitude','latitude','lead(longitude) over w','lead(latitude) over w')} as nxt
 from k5 window w as ({W_FLIGHT}))""",
    f"""kpi AS (select flight_id, coalesce(sum(coalesce(case when leveltime > 0 then nxt else 0.0 end, 0.0)), 0.0) as kpi17_distance,
  coalesce(sum(nxt), 0.0) as flown_distance_kpi17, coalesce(sum(leveltime), 0.0) as kpi17_time,
  coalesce(last(time order by {ORD}) - first(time order by {ORD}), 0.0) as transit_time_kpi17
 from k6 group by flight_id)""",
]
KPI_COLS = ["kpi17_distance", "flown_distance_kpi17", "kpi17_time", "transit_time_kpi17"]

ORACLE["level_flight_kpi"] = with_(*phased_ctes(), *FLAG_CTES, *KPI_CTES) + "select flight_id, " + ", ".join(
    f"{sig(c)} as {c}" for c in KPI_COLS) + " from kpi"

TRAJ_FEATURE_CTES = [*phased_ctes(), *SUMMARY_CTES, *ENERGY_CTES, *LIFT_CTES, *SAMPLE_CTES,
                     *FLAG_CTES, *KPI_CTES, """tf AS (select s.*, e.* exclude (flight_id), l.* exclude (flight_id),
  c.* exclude (flight_id), k.* exclude (flight_id)
 from sfl s left join energy e on s.flight_id = e.flight_id left join lift l on s.flight_id = l.flight_id
 left join samples c on s.flight_id = c.flight_id left join kpi k on s.flight_id = k.flight_id)"""]
TRAJ_FEATURE_COLS = _summary_cols() + ENERGY_COLS + LIFT_COLS + SAMPLE_COLS + KPI_COLS

ORACLE["trajectory_features"] = with_(*TRAJ_FEATURE_CTES) + "select flight_id, " + ", ".join(
    f"{sig(_coalesce0(c))} as {c}" for c in TRAJ_FEATURE_COLS) + " from tf"


from . import o_features  # noqa: E402,F401

from . import o_frame  # noqa: E402,F401

from . import o_encode  # noqa: E402,F401

from . import o_model  # noqa: E402,F401

from . import o_io  # noqa: E402,F401

from . import o_misc  # noqa: E402,F401
