"""Oracle SQL for the source/sink round trips and the day halo."""

from __future__ import annotations

from .oracle import ORACLE, SUMMARY_CTES, _coalesce0, _summary_cols
from .q_io import HALO_DAY
from .sqltext import FX_AIRPORTS, FX_FLIGHTS, FX_FLIGHTS_FULL, FX_TRAJ, phased_ctes, sig, with_

ORACLE["csv_roundtrip"] = with_(FX_FLIGHTS, FX_FLIGHTS_FULL) + (
    "select flight_id, callsign, adep, ades, actual_offblock_time, arrival_time, "
    + ", ".join(f"{sig(c)} as {c}" for c in ["flight_duration", "taxiout_time", "flown_distance"])
    + f", airline, wtc, aircraft_type, {sig('tow')} as tow from fx_flights_full")

ORACLE["day_partition_roundtrip"] = with_(FX_AIRPORTS, FX_FLIGHTS, FX_TRAJ) + \
    f"select flight_id, event_id, strftime(\"timestamp\", '%Y-%m-%d') as file_date, {sig('altitude')} as altitude from fx_traj"

ORACLE["delim_noheader_roundtrip"] = with_(FX_AIRPORTS) + \
    f"select icao, {sig('lat')} as lat, {sig('lon')} as lon, {sig('altitude')} as altitude from fx_airports"

ORACLE["inline_rows"] = with_(FX_FLIGHTS) + (
    "select * from (values ('A0', 1.0::double, 2.0::double, 3.0::double), ('A9', 4.5::double, 5.5::double, 66.0::double), "
    "('A12', 0.0::double, 0.0::double, 0.0::double)) t(icao, lat, lon, altitude) "
    "where icao in (select adep from fx_flights)")

_HALO = f"""fx_halo AS (select * from fx_traj where cast("timestamp" as date) between date '{HALO_DAY}' - 1 and date '{HALO_DAY}' + 1
 and flight_id in (select flight_id from fx_traj where cast("timestamp" as date) = date '{HALO_DAY}'))"""
ORACLE["halo_days"] = with_(*phased_ctes(src="fx_halo", extra=(_HALO,)), *SUMMARY_CTES) + "select flight_id, " + \
    ", ".join(f"{sig(_coalesce0(c))} as {c}" for c in _summary_cols()) + " from sfl"

from .o_features import TRAJ_SUMMARY  # noqa: E402
from .oracle import TRAJ_FEATURE_COLS, TRAJ_FEATURE_CTES  # noqa: E402

ORACLE["trajectory_table"] = with_(*TRAJ_FEATURE_CTES) + (
    "select f.flight_id, f.callsign, f.adep, f.ades, f.actual_offblock_time, f.arrival_time, "
    + ", ".join(f"{sig('f.' + c)} as {c}" for c in ["flight_duration", "taxiout_time", "flown_distance"])
    + ", f.airline, f.wtc, f.aircraft_type, " + sig("f.tow") + " as tow, "
    + ", ".join(f"{sig(_coalesce0('tf.' + c) if False else _coalesce0(c))} as {c}" for c in TRAJ_FEATURE_COLS)
    + " from fx_flights f join tf on f.flight_id = tf.flight_id")
