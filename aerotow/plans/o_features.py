"""Oracle SQL for the flight-list feature queries."""

from __future__ import annotations

from ..functions.regions import DIRECTIONS, REGION_COUNTRIES
from ..operators import tabular as tb
from ..sources.fixtures import PATCH_AIRPORTS
from .oracle import ORACLE, SUMMARY_CTES, _coalesce0, _summary_cols
from .q_features import DURATION_COLS, LINEITEM_BINS, TIME_COLS
from .sqltext import (FX_AIRCRAFT_EXTRA, FX_AIRCRAFT_FAA, FX_AIRPORTS, FX_FLIGHTS, FX_FLIGHTS_FULL,
                      days_sql, div, finite_sql, minutes_sql, phased_ctes, rush_sql, sig,
                      time_parts_sql, with_)

OFF, ARR = "actual_offblock_time", "arrival_time"

ORACLE["time_features"] = with_(FX_FLIGHTS, FX_FLIGHTS_FULL) + "select flight_id, " + ",\n ".join(
    time_parts_sql(OFF, "offblock") + time_parts_sql(ARR, "arrival") + [
        f"{sig(minutes_sql(OFF, ARR))} as offblock_to_arrival_duration",
        f"cast(isodow({OFF}) - 1 >= 5 as int) as is_offblock_weekend",
        f"{rush_sql(f'hour({OFF})')} as is_offblock_rush_hour",
        f"cast(isodow({ARR}) - 1 >= 5 as int) as is_arrival_weekend",
        f"{rush_sql(f'hour({ARR})')} as is_arrival_rush_hour",
        f"{days_sql(OFF, ARR)} as offblock_to_arrival_day_diff",
    ]) + f" from fx_flights_full where {OFF} is not null and {ARR} is not null"
assert len(TIME_COLS) == 26

# Summary with the sums completed (as the Spark phase_summary output).
SUMMARY_FULL = SUMMARY_CTES + ["sfx AS (select flight_id, " + ", ".join(
    f"{_coalesce0(c)} as {c}" for c in _summary_cols()) + " from sfl)"]
TRAJ_SUMMARY = [*phased_ctes(), *SUMMARY_FULL, "sfr AS (select flight_id, " + ", ".join(
    f"{sig(c)} as {c}" for c in _summary_cols()) + " from sfx)"]

_cut = ("case when fd >= 0 and fd < 60 then 'Very Short' when fd >= 60 and fd < 180 then 'Short' "
        "when fd >= 180 and fd < 300 then 'Medium' when fd >= 300 then 'Long' end")

ORACLE["duration_features"] = with_(*TRAJ_SUMMARY[:2], FX_FLIGHTS_FULL, *TRAJ_SUMMARY[2:], f"""
base AS (select f.*, s.flown_distance_ENR from fx_flights_full f left join sfx s on f.flight_id = s.flight_id)""", """
d1 AS (select flight_id, flown_distance, flown_distance_ENR, case when flight_duration <> 0 then flight_duration end as fd,
  case when taxiout_time <> 0 then taxiout_time end as tx0 from base)""", """
m1 AS (select median(tx0) as m_tx from d1)""", """
d2 AS (select d1.*, coalesce(tx0, m_tx) as tx from d1, m1)""", f"""
d3 AS (select *, {div('tx', 'fd')} as r0, {finite_sql(div('flown_distance', 'fd'))} as s0,
  {finite_sql(div('flown_distance_ENR', 'fd - tx'))} as e0, {finite_sql(div('flown_distance_ENR', 'flown_distance'))} as q0 from d2)""", """
m2 AS (select median(r0) as m_r, median(s0) as m_s, median(e0) as m_e, median(q0) as m_q from d3)""", """
d4 AS (select d3.*, coalesce(s0, m_s) as flight_speed, m_r, m_e, m_q from d3, m2)""", f"""
d5 AS (select *, {finite_sql(div('flight_speed', 'flown_distance'))} as p0 from d4)""", """
m3 AS (select median(p0) as m_p from d5)""", """
d6 AS (select d5.*, m_p from d5, m3)""") + f"""
select flight_id, {sig('fd')} as flight_duration, {sig('tx')} as taxiout_time, {sig('coalesce(r0, m_r)')} as taxi_ratio,
 {sig('flight_speed')} as flight_speed, {sig(div('coalesce(r0, m_r)', 'm_r'))} as normalized_taxi_ratio,
 {_cut} as flight_duration_category, {sig('coalesce(p0, m_p)')} as speed_per_distance,
 {sig('avg(flight_speed) over (order by flight_id rows between unbounded preceding and current row)')} as cumulative_avg_speed,
 {sig('coalesce(e0, m_e)')} as avg_speed_ENR, {sig('coalesce(q0, m_q)')} as ENR_distance_ratio,
 {sig('fd - tx')} as flight_time_excl_taxi from d6"""
assert len(DURATION_COLS) == 11


def _region_values() -> str:
    seen, rows = set(), []
    for region, codes in REGION_COUNTRIES.items():
        for c in codes:
            if c not in seen:
                seen.add(c)
                rows.append(f"('{c}', '{region}')")
    return "rg AS (select * from (values " + ", ".join(rows) + ") t(country, region))"


_known = ", ".join(f"'{r}'" for r in REGION_COUNTRIES)
_dir = "case " + " ".join(f"when adep_region = '{a}' and ades_region = '{b}' then '{lab}'"
                          for a, b, lab in DIRECTIONS) + " else 'Other' end"

ORACLE["region_features"] = with_(FX_FLIGHTS, FX_FLIGHTS_FULL, _region_values(), """
r1 AS (select f.*, coalesce(a.region, case when f.country_code_adep is not null then 'Other' else 'Unknown' end) as adep_region,
  coalesce(b.region, case when f.country_code_ades is not null then 'Other' else 'Unknown' end) as ades_region
 from fx_flights_full f left join rg a on f.country_code_adep = a.country left join rg b on f.country_code_ades = b.country)""") + f"""
select flight_id, country_code_adep, country_code_ades, adep_region, ades_region,
 cast(coalesce(country_code_adep = country_code_ades, false) as int) as same_country_flight,
 cast(coalesce(adep_region = ades_region, false) as int) as same_region_flight, {_dir} as flight_direction,
 cast(coalesce(adep_region in ({_known}) and ades_region in ({_known}) and adep_region <> ades_region, false) as int) as is_intercontinental
from r1"""


def _qcut_expr(x: str, e: str) -> str:
    return (f"(case when {x} is not null and {x} >= {e}[1] and {x} <= {e}[6] then "
            f"cast(greatest(len(list_distinct(list_filter({e}, lambda v: v < {x}))) - 1, 0) as int) end)")


_inter = [f"{a}_{ph} * {b}_{ph} as {n}_{t}" for n, a, b in tb.INTERACTIONS for t, ph in tb.PHASE_TAGS.items()]
_rc = tb.ratio_columns()
_qedges = ", ".join(f"quantile_cont({c}, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) as e_{o}" for o, c in tb.QCUT_COLUMNS.items())

ORACLE["interactions_ratios_bins"] = with_(*TRAJ_SUMMARY[:2], FX_FLIGHTS_FULL, *TRAJ_SUMMARY[2:], """
ib AS (select f.*, s.* exclude (flight_id) from fx_flights_full f join sfr s on f.flight_id = s.flight_id)""",
    "ir AS (select *, " + ", ".join(f"{finite_sql(div(a, b))} as {n}" for n, (a, b) in _rc.items()) + " from ib)",
    "im AS (select " + ", ".join(f"median({n}) as m_{n}" for n in _rc) + " from ir)",
    f"ie AS (select {_qedges} from ib)") + "select flight_id, " + ", ".join(
    [sig(x.rsplit(' as ', 1)[0]) + " as " + x.rsplit(' as ', 1)[1] for x in _inter]
    + [f"{_qcut_expr(c, 'e_' + o)} as {o}" for o, c in tb.QCUT_COLUMNS.items()]
    + [f"{sig(f'coalesce({n}, m_{n})')} as {n}" for n in _rc]) + " from ir, im, ie"

ORACLE["qcut_lineitem"] = ("WITH ie AS (select " + ", ".join(
    f"quantile_cont({c}, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) as e_{o}" for o, c in LINEITEM_BINS.items())
    + " from lineitem)\nselect l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"{_qcut_expr(c, 'e_' + o)} as {o}" for o, c in LINEITEM_BINS.items()) + " from lineitem, ie")

_EXTRA = ["mzfw_kg", "max_fuel_l", "seats_typ", "cargo_capacity", "range_km", "tas_knots", "wingspan_m",
          "length_m", "height_m", "oew_kg", "seats_min", "seats_max"]
_CLASS = ("case when Physical_Class_Engine = 'Turboprop' and wtc = 'M' then 'Medium Turbo Prop' "
          "when Physical_Class_Engine = 'Jet' and wtc = 'M' then 'Medium Jet' "
          "when Physical_Class_Engine = 'Jet' and wtc = 'H' then 'Heavy Jet' end")
_FAA_J = """faaj AS (select FAA_Designator as aircraft_type, Manufacturer, Model_FAA, Physical_Class_Engine, Num_Engines,
  Approach_Speed_knot, FAA_Weight, MTOW_lb*0.453592::double as MTOW_kg, MALW_lb*0.453592::double as MALW_kg from fx_aircraft_faa)"""

ORACLE["aircraft_features"] = with_(FX_FLIGHTS, FX_FLIGHTS_FULL, FX_AIRCRAFT_FAA, FX_AIRCRAFT_EXTRA, _FAA_J, """
af AS (select f.*, a.* exclude (aircraft_type), x.* exclude (aircraft_type) from fx_flights_full f
 left join faaj a on f.aircraft_type = a.aircraft_type left join fx_aircraft_extra x on f.aircraft_type = x.aircraft_type)""") + \
    "select flight_id, aircraft_type, " + sig("tow") + " as tow, Manufacturer, Model_FAA, Physical_Class_Engine, Num_Engines, " + \
    f"{sig('Approach_Speed_knot')} as Approach_Speed_knot, FAA_Weight, {sig('MTOW_kg')} as MTOW_kg, {sig('MALW_kg')} as MALW_kg, " + \
    f"{_CLASS} as Aircraft_Class, " + ", ".join(f"{sig(c)} as {c}" for c in _EXTRA) + " from af"

_patch = ", ".join(f"('{i}', {a!r}::double, {b!r}::double, {c!r}::double)" for i, a, b, c in PATCH_AIRPORTS)
AIRPORTS_COMBINED = [FX_AIRPORTS, """ab AS (select concat('A', cast(s_suppkey as varchar)) as icao,
  cast((s_suppkey*7)%120 as double)-60+0.5 as lat, cast((s_suppkey*13)%360 as double)-180-0.5 as lon,
  cast((s_suppkey*31)%900 as double)+10 as altitude, s_suppkey as line from supplier where s_suppkey%9=0 or s_suppkey%4=0)""",
                     f"patch AS (select * from (values {_patch}) t(icao, lat, lon, altitude))", """
allap AS (select icao, lat, lon, altitude, 0 as sr, 0 as line from fx_airports union all
  select icao, lat, lon, altitude, 1, line from ab union all select icao, lat, lon, altitude, 2, 0 from patch)""", """
apc AS (select icao, lat, lon, altitude from (select *, row_number() over (partition by icao order by sr, line) as rn from allap) q where rn = 1)"""]

_hkm = ("6371.0::double * 2 * atan2(sqrt(pow(sin((radians(Latitude_ades)-radians(Latitude_adep))/2),2) + "
        "cos(radians(Latitude_adep))*cos(radians(Latitude_ades))*pow(sin((radians(Longitude_ades)-radians(Longitude_adep))/2),2)), "
        "sqrt(1 - (pow(sin((radians(Latitude_ades)-radians(Latitude_adep))/2),2) + "
        "cos(radians(Latitude_adep))*cos(radians(Latitude_ades))*pow(sin((radians(Longitude_ades)-radians(Longitude_adep))/2),2))))")
_bear = ("(degrees(atan2(sin(radians(Longitude_ades)-radians(Longitude_adep))*cos(radians(Latitude_ades)), "
         "cos(radians(Latitude_adep))*sin(radians(Latitude_ades)) - sin(radians(Latitude_adep))*cos(radians(Latitude_ades))"
         "*cos(radians(Longitude_ades)-radians(Longitude_adep)))) + 360)")

ORACLE["airport_geometry"] = with_(FX_FLIGHTS, FX_FLIGHTS_FULL, *AIRPORTS_COMBINED, """
ag AS (select f.flight_id, a.lat as Latitude_adep, a.lon as Longitude_adep, a.altitude as Altitude_adep,
  b.lat as Latitude_ades, b.lon as Longitude_ades, b.altitude as Altitude_ades
 from fx_flights_full f left join apc a on f.adep = a.icao left join apc b on f.ades = b.icao)""",
    f"ag2 AS (select *, {_hkm} as actual_distance, Altitude_ades - Altitude_adep as altitude_difference, "
    f"{_bear} - 360.0 * floor({_bear} / 360.0) as bearing from ag)") + \
    "select flight_id, " + ", ".join(f"{sig(c)} as {c}" for c in [
        "Latitude_adep", "Longitude_adep", "Altitude_adep", "Latitude_ades", "Longitude_ades", "Altitude_ades",
        "actual_distance", "altitude_difference", "bearing"]) + \
    f", {sig(finite_sql(div('altitude_difference', 'actual_distance')))} as elevation_gradient from ag2"

ORACLE["clip_to_mtow"] = with_(FX_FLIGHTS, FX_AIRCRAFT_FAA, _FAA_J, """
c0 AS (select f.flight_id, f.tow*10 as tow, a.MTOW_kg from fx_flights f left join faaj a on f.aircraft_type = a.aircraft_type)""") + \
    f"select flight_id, {sig('tow')} as tow_before, {sig('case when tow > MTOW_kg then MTOW_kg else tow end')} as tow, {sig('MTOW_kg')} as MTOW_kg from c0"


ORACLE["clip_counts"] = with_(FX_FLIGHTS, FX_AIRCRAFT_FAA, _FAA_J, """
c0 AS (select f.flight_id, f.tow*10 as tow, a.MTOW_kg from fx_flights f left join faaj a on f.aircraft_type = a.aircraft_type)""") + \
    "select count(*) filter (where tow > MTOW_kg) as over_before, 0 as over_after, count(*) as n from c0"

ORACLE["airport_altitude_units"] = with_(*AIRPORTS_COMBINED[:2], """
u AS (select icao, altitude, 0 as sr, 0 as line from fx_airports union all select icao, altitude / 0.3048::double, 1, line from ab)""", """
one AS (select icao, altitude from (select *, row_number() over (partition by icao order by sr, line) as rn from u) q where rn = 1)""") + \
    f"select icao, {sig('altitude')} as altitude from one"
