"""SQL text for the DuckDB oracle (reference answers of the registered queries).

Only the driver tables are registered there, so every stand-in table and
intermediate is a CTE.  Expression builders mirror the Column builders of
the library so that the arithmetic happens in the same order.
"""

from __future__ import annotations

from ..functions.flight import STICKY_PAIRS
from ..sources.fixtures import COUNTRY_BY_DIGIT, PREDICTION_MODELS

FX_AIRPORTS = """fx_airports AS (
 select concat('A', cast(s_suppkey as varchar)) as icao, cast((s_suppkey*7)%120 as double)-60 as lat,
  cast((s_suppkey*13)%360 as double)-180 as lon, cast((s_suppkey*31)%900 as double) as altitude
 from supplier where s_suppkey%9<>0)"""

FX_FLIGHTS = """fx_flights AS (
 select o_orderkey as flight_id, concat('C',cast(o_custkey as varchar)) as callsign,
  concat('A',cast(o_orderkey%100 as varchar)) as adep, concat('A',cast((o_orderkey+1+o_custkey%3)%100 as varchar)) as ades,
  o_orderdate + interval '1' minute * cast((o_orderkey*37)%1440 as int) as actual_offblock_time,
  o_orderdate + interval '1' minute * cast((o_orderkey*37)%1440+(o_orderkey*53)%600+o_orderkey%31 as int) as arrival_time,
  cast((o_orderkey*53)%600 as double) as flight_duration, cast(o_orderkey%31 as double) as taxiout_time,
  o_totalprice/100 as flown_distance, c_mktsegment as airline,
  case when o_orderkey%4=0 then 'H' else 'M' end as wtc, concat('T',cast(o_custkey%30 as varchar)) as aircraft_type, o_totalprice as tow
 from orders join customer on o_custkey=c_custkey)"""

FX_TRAJ = """fx_traj AS (
 select e.user_id as flight_id, e.event_id, e.ts as "timestamp",
  la+(lb-la)*(x*x*x*(10-15*x+6*x*x)) as latitude, lo+(lp-lo)*(x*x*x*(10-15*x+6*x*x)) as longitude,
  case when event_id%13=0 then null else cast(least(rn-1,n-rn,12) as double)*3000+value end as altitude,
  case when event_id%7=0 then null when event_id%5=0 then 100.0::double when rn<=12 then 1500.0+value when n-rn<12 then -1500.0-value else value-50 end as vertical_rate,
  250.0+value as groundspeed, cast((event_id*37)%360 as double) as track,
  cast(event_id%21 as double)-10 as u_component_of_wind, cast(event_id%17 as double)-8 as v_component_of_wind,
  cast(288.15 as double)-least(rn-1,n-rn,12)*cast(5.9436 as double) as temperature, value/10000 as specific_humidity
 from (select *, cast(rn-1 as double)/(n-1) as x from (select *, row_number() over(partition by user_id order by ts,event_id) rn, count(*) over(partition by user_id) n from events) q) e
 join (select f.flight_id, coalesce(a.lat,10.0) la, coalesce(a.lon,20.0) lo, coalesce(b.lat,13.0) lb, coalesce(b.lon,24.0) lp
   from fx_flights f left join fx_airports a on f.adep=a.icao left join fx_airports b on f.ades=b.icao) g on e.user_id=g.flight_id)"""

FX_PHASE = """fx_phase AS (select user_id as flight_id, event_id, ts as "timestamp", event_type as phase from events)"""


def country_sql(icao: str) -> str:
    arr = ", ".join(f"'{c}'" for c in COUNTRY_BY_DIGIT)
    return f"([{arr}])[cast(cast(substr({icao}, 2) as bigint) % 10 as int) + 1]"


FX_FLIGHTS_FULL = f"""fx_flights_full AS (
 select * replace (case when flight_id % 5 <> 0 then tow end as tow),
  {country_sql('adep')} as country_code_adep, {country_sql('ades')} as country_code_ades
 from fx_flights)"""

FX_AIRCRAFT_FAA = """fx_aircraft_faa AS (
 select aircraft_type as FAA_Designator, 1000.0::double*(n+100) as MTOW_lb, 900.0::double*(n+100) as MALW_lb,
  concat('M', cast(n%4 as varchar)) as Manufacturer, concat('Model', cast(n as varchar)) as Model_FAA,
  case when n%2=0 then 'Jet' else 'Turboprop' end as Physical_Class_Engine,
  concat('W', cast(n%3 as varchar)) as FAA_Weight, cast(2+(n%2)*2 as int) as Num_Engines,
  120.0::double + n as Approach_Speed_knot
 from (select distinct aircraft_type, cast(substr(aircraft_type, 2) as int) as n from fx_flights) t
 where n%7<>6)"""

FX_AIRCRAFT_EXTRA = """fx_aircraft_extra AS (
 select aircraft_type, n*1000+40000 as mzfw_kg, n*500+20000 as max_fuel_l, n*5+100 as seats_typ,
  n*2+10 as cargo_capacity, n*100+3000 as range_km, n+400 as tas_knots, n*0.5::double+30 as wingspan_m,
  n*0.7::double+30 as length_m, n*0.1::double+10 as height_m, n*800+30000 as oew_kg, n*4+80 as seats_min,
  n*6+120 as seats_max
 from (select distinct aircraft_type, cast(substr(aircraft_type, 2) as double) as n from fx_flights) t
 where n%3<>2)"""


def fx_predictions_sql() -> str:
    cols = ", ".join(
        f"tow*(1.0::double+{c}::double*cast(((flight_id*{k})%101)-50 as double)/1000) as {name}"
        for name, (c, k) in PREDICTION_MODELS.items())
    return f"fx_predictions AS (select flight_id, tow, {cols} from fx_flights)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------- expressions

def hav_m(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = 6378137.0) -> str:
    a = (f"pow(sin((radians({lat2})-radians({lat1}))/2),2) + cos(radians({lat1}))*cos(radians({lat2}))"
         f"*pow(sin((radians({lon2})-radians({lon1}))/2),2)")
    return (f"(case when {lon1} is not null and {lat1} is not null and {lon2} is not null and {lat2} is not null "
            f"then {2.0 * radius!r}::double*asin(least(1.0::double, sqrt({a}))) end)")


def hav_nm(lon1, lat1, lon2, lat2) -> str:
    return f"(5.39957e-4*{hav_m(lon1, lat1, lon2, lat2)})"


def epoch_s(ts: str) -> str:
    return f"(cast(epoch_us({ts}) as double)/1e6)"


def tail() -> str:
    return "(sin(radians(track))*u_component_of_wind + cos(radians(track))*v_component_of_wind)"


def tas() -> str:
    return f"(groundspeed*0.514444::double - {tail()})"


def energy(tas_expr: str) -> str:
    return f"({tas_expr}*{tas_expr} + 9.8::double*(altitude*0.3048::double))"


def r_ifelse(cond: str, yes: str, no: str) -> str:
    return f"(case when {cond} then {yes} when ({cond}) is null then null else {no} end)"


def sig(expr: str, bits: int = 30) -> str:
    """Round a double to ``bits`` significant binary digits (as the Spark side)."""
    x = f"({expr})"
    sc = f"pow(2.0::double, cast({bits - 1} - floor(log2(abs{x})) as double))"
    return f"(case when {x} = 0 then 0.0::double else cast(floor({x}*{sc} + 0.5) as double)/{sc} end)"


W_FLIGHT = 'partition by flight_id order by "timestamp", event_id'


def phased_ctes(sticky: bool = True, short_route: bool = True, src: str = "fx_traj",
                extra: tuple[str, ...] = ()) -> list[str]:
    """CTEs p0..pN ending in ``ph``: the phased points (of ``src``)."""
    ctes = [FX_AIRPORTS, FX_FLIGHTS, FX_TRAJ, *extra]
    ctes.append(f"""p0 AS (select flight_id, event_id, "timestamp", latitude, longitude, altitude,
  coalesce(vertical_rate, ((lead(altitude,10) over w - altitude) / ({epoch_s('lead("timestamp",10) over w')} - {epoch_s('"timestamp"')}))*60) as vertical_rate,
  groundspeed, track, u_component_of_wind, v_component_of_wind, temperature, specific_humidity
 from {src} window w as ({W_FLIGHT}))""")
    ctes.append("""p1 AS (select p0.*, f.adep, f.ades, a.lon as adep_lon0, a.lat as adep_lat0, a.altitude as adep_altitude,
  b.lon as ades_lon0, b.lat as ades_lat0, b.altitude as ades_altitude
 from p0 left join fx_flights f on p0.flight_id=f.flight_id left join fx_airports a on f.adep=a.icao
 left join fx_airports b on f.ades=b.icao)""")
    ctes.append(f"""p2 AS (select *, coalesce(ades_lon0, last_value(longitude) over wf) as ades_lon,
  coalesce(ades_lat0, last_value(latitude) over wf) as ades_lat,
  coalesce(adep_lon0, first_value(longitude) over wf) as adep_lon,
  coalesce(adep_lat0, first_value(latitude) over wf) as adep_lat
 from p1 window wf as ({W_FLIGHT} rows between unbounded preceding and unbounded following))""")
    ctes.append(f"""p3 AS (select *, {hav_nm('longitude','latitude','adep_lon','adep_lat')} as dist_adep,
  {hav_nm('longitude','latitude','ades_lon','ades_lat')} as dist_ades,
  {hav_nm('adep_lon','adep_lat','ades_lon','ades_lat')} as dist_airp from p2)""")
    ctes.append("""p4 AS (select *, case when dist_ades is null then null when dist_ades<=1 then 'GND_ARR'
  when dist_ades<=100 then 'ARR_100' when dist_adep is null then null when dist_adep>100 then 'ENR'
  when dist_adep>40 then 'DEP_100' when dist_adep>1 then 'DEP_40' else 'GND_DEP' end as phase from p3)""")
    last = "p4"
    if sticky:
        for i, (frm, to) in enumerate(STICKY_PAIRS):
            ctes.append(f"""h{i} AS (select *, cast(coalesce(lag(phase) over w = '{to}' and phase = '{frm}', false) as int) as hit
 from {last} window w as ({W_FLIGHT}))""")
            ctes.append(f"""s{i} AS (select * exclude (hit) replace (case when phase = '{frm}' and max(hit) over wr > 0 then '{to}' else phase end as phase)
 from h{i} window wr as ({W_FLIGHT} rows between unbounded preceding and current row))""")
            last = f"s{i}"
    if short_route:
        c1 = "dist_airp <= 140 and coalesce(phase in ('DEP_100','ARR_100'), false)"
        c2 = "dist_airp > 140 and dist_airp <= 200 and coalesce(phase = 'DEP_100', false)"
        c3 = "dist_airp >= 140 and dist_ades <= 100 and dist_ades > 40"
        ctes.append(f"r1 AS (select * replace ({r_ifelse(c1, chr(39) + 'ENR' + chr(39), 'phase')} as phase) from {last})")
        ctes.append(f"r2 AS (select * replace ({r_ifelse(c2, chr(39) + 'ENR' + chr(39), 'phase')} as phase) from r1)")
        ctes.append(f"r3 AS (select * replace ({r_ifelse(c3, chr(39) + 'ARR_100' + chr(39), 'phase')} as phase) from r2)")
        last = "r3"
    ctes.append(f"ph AS (select * from {last})")
    return ctes


def div(a: str, b: str) -> str:
    """a / b with null for a zero divisor (as try_divide)."""
    return f"(case when ({b}) = 0 then null else ({a})/({b}) end)"


def finite_sql(x: str) -> str:
    return f"(case when isnan({x}) or isinf({x}) then null else {x} end)"


def time_parts_sql(ts: str, prefix: str) -> list[str]:
    return [
        f"cast(hour({ts}) as int) as {prefix}_hour",
        f"cast(minute({ts}) as int) as {prefix}_minute",
        f"cast(isodow({ts}) - 1 as int) as {prefix}_day_of_week",
        f"cast(dayofyear({ts}) as int) as {prefix}_day_of_year",
        f"cast(month({ts}) as int) as {prefix}_month",
        f"cast(weekofyear({ts}) as int) as {prefix}_week_of_year",
        f"cast(quarter({ts}) as int) as {prefix}_quarter",
        f"cast(year({ts}) as int) as {prefix}_year",
        f"case when month({ts}) in (12,1,2) then 'Winter' when month({ts}) in (3,4,5) then 'Spring' "
        f"when month({ts}) in (6,7,8) then 'Summer' else 'Fall' end as {prefix}_season",
        f"dayname({ts}) as {prefix}_weekday_name",
    ]


def minutes_sql(a: str, b: str) -> str:
    return f"(cast(date_diff('microsecond', {a}, {b}) as double)/1e6/60.0)"


def days_sql(a: str, b: str) -> str:
    return f"cast(floor(cast(date_diff('microsecond', {a}, {b}) as double)/1e6/86400.0) as bigint)"


def rush_sql(h: str) -> str:
    return f"cast(({h} >= 7 and {h} <= 9) or ({h} >= 16 and {h} <= 18) as int)"
