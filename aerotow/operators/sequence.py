"""Key, order and clock of a flight's points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = "flight_id"
ORDER = ("timestamp", "event_id")


def epoch_micros(ts="timestamp") -> Column:
    """Microseconds since 1970 for TIMESTAMP_NTZ, independent of the session zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def epoch_seconds(ts="timestamp") -> Column:
    return epoch_micros(ts).cast("double") / F.lit(1e6)
