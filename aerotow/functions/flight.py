"""Flight-physics and classification expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import FT_TO_M, KT_TO_MS
from .nulls import r_ifelse

# Phase names and the order used when sorting rows of a flight.
PHASE_ORDER = ["GND_DEP", "DEP_40", "DEP_100", "ENR", "ARR_100", "ARR_40", "GND_ARR"]
# The sticky (from, to) pairs, applied in this order.
STICKY_PAIRS = [("GND_DEP", "DEP_40"), ("DEP_40", "DEP_100"), ("DEP_100", "ENR"),
                ("ENR", "ARR_100"), ("ARR_100", "ARR_40"), ("ARR_40", "GND_ARR")]
# Summary phases and the merge of DEP_100 into ENR, ARR_40 into ARR_100.
SUMMARY_PHASES = ["DEP_40", "ENR", "ARR_100"]
SUMMARY_MERGE = {"DEP_40": "DEP_40", "DEP_100": "ENR", "ENR": "ENR",
                 "ARR_100": "ARR_100", "ARR_40": "ARR_100"}
GRAVITY = 9.8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tailwind(track_deg="track", u="u_component_of_wind", v="v_component_of_wind") -> Column:
    t = F.radians(_c(track_deg))
    return F.sin(t) * _c(u) + F.cos(t) * _c(v)


def airspeed(groundspeed_kt="groundspeed", tail: Column | None = None) -> Column:
    """True airspeed (m/s) = ground speed (kt -> m/s) minus tailwind."""
    tail = tailwind() if tail is None else tail
    return _c(groundspeed_kt) * F.lit(KT_TO_MS) - tail


def specific_energy(tas: Column, altitude_ft="altitude") -> Column:
    """tas^2 + g * altitude (m); no 1/2 factor, as in the reference."""
    return tas * tas + F.lit(GRAVITY) * (_c(altitude_ft) * F.lit(FT_TO_M))


def phase_initial(dist_adep="dist_adep", dist_ades="dist_ades") -> Column:
    """Distance-based phase; later rules of the reference override earlier ones."""
    dp, ds = _c(dist_adep), _c(dist_ades)
    return (F.when(ds.isNull(), F.lit(None))
            .when(ds <= 1, "GND_ARR")
            .when(ds <= 100, "ARR_100")
            .when(dp.isNull(), F.lit(None))
            .when(dp > 100, "ENR")
            .when(dp > 40, "DEP_100")
            .when(dp > 1, "DEP_40")
            .otherwise("GND_DEP"))


def phase_short_route(phase: Column, dist_airp="dist_airp", dist_ades="dist_ades") -> Column:
    """Re-label phases of short routes (three rules applied in order)."""
    da, ds = _c(dist_airp), _c(dist_ades)
    # ``%in%`` is never missing: a null phase is simply not in the list.
    in1 = F.coalesce(phase.isin("DEP_100", "ARR_100"), F.lit(False))
    p = r_ifelse((da <= 140) & in1, F.lit("ENR"), phase)
    in2 = F.coalesce(p == "DEP_100", F.lit(False))
    p = r_ifelse((da > 140) & (da <= 200) & in2, F.lit("ENR"), p)
    p = r_ifelse((da >= 140) & (ds <= 100) & (ds > 40), F.lit("ARR_100"), p)
    return p


def aircraft_class(engine="Physical_Class_Engine", wtc="wtc") -> Column:
    e, w = _c(engine), _c(wtc)
    return (F.when((e == "Turboprop") & (w == "M"), "Medium Turbo Prop")
             .when((e == "Jet") & (w == "M"), "Medium Jet")
             .when((e == "Jet") & (w == "H"), "Heavy Jet"))
