"""Incremental day-by-day trajectory features with Structured Streaming.

New day files arriving in a folder are discovered by the file stream source;
each micro-batch names the days it brought, and ``foreachBatch`` computes the
features of those days and of the stored days around them, each from the day and
its neighbours (the halo), with every flight published under its first day, reading the day-partitioned store with
partition pruning.  Results are written to a folder per day, so a retried batch
rewrites the same folders (idempotent); the stream's
progress lives under the shared checkpoint folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trajectory import halo_slice, trajectory_features
from ..session import shared_path
from ..sources.files import scan_day_parquet


def process_day(spark: SparkSession, points_dir: str, day: str, flights: DataFrame, airports: DataFrame,
                out_dir: str, halo: int = 1, date_col: str = "file_date") -> None:
    """Features of the flights whose first stored day is ``day`` (points from the halo days).

    A flight belongs to its first day, so it is published once: a flight that was seen within the halo before ``day``
    is left to that day. (An id that comes back after a longer gap counts as another flight.)
    """
    pts = scan_day_parquet(spark, points_dir, date_col=date_col)
    earlier = (pts.where(F.col(date_col).cast("date").between(F.date_sub(F.to_date(F.lit(day)), halo), F.date_sub(F.to_date(F.lit(day)), 1)))
               .select("flight_id").distinct())
    sl = halo_slice(pts, day, halo, date_col=date_col).drop(date_col).join(earlier, "flight_id", "left_anti")
    # written to the day's own folder, so that a day whose flights all belong to an earlier one becomes empty
    trajectory_features(sl, flights, airports).write.mode("overwrite").parquet(f"{out_dir}/{date_col}={day}")


def days_to_refresh(arrived: list[str], present: list[str], halo: int = 1) -> list[str]:
    """Stored days whose result depends on a day that has arrived: the day itself and its halo on both sides."""
    import datetime as dt

    near = {(dt.date.fromisoformat(d) + dt.timedelta(days=k)).isoformat() for d in arrived for k in range(-halo, halo + 1)}
    return sorted(near & set(present))


def run_daily_stream(spark: SparkSession, points_dir: str, flights: DataFrame, airports: DataFrame,
                     out_dir: str, schema, checkpoint: str | None = None, halo: int = 1,
                     date_col: str = "file_date", files_per_batch: int = 1000,
                     on_day: Callable[[str], None] | None = None):
    """Process every day file that is new (``availableNow``) and stop.

    When a day arrives, its own result and those of the stored days around it are computed again, so days may arrive
    in separate runs and in any order and end with the batch result. A batch takes up to ``files_per_batch`` files,
    so a day of several files is computed once. ``schema`` is the schema of the point files (streams do not infer).
    The stream's progress is kept by ``out_dir`` unless ``checkpoint`` names a folder. Returns the finished query.
    """
    checkpoint = checkpoint or shared_path(spark, "streams/daily-" + hashlib.sha256(out_dir.encode()).hexdigest()[:16])
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
              .parquet(points_dir))

    def batch(df: DataFrame, epoch: int) -> None:
        arrived = [r[0] for r in df.select(F.col(date_col).cast("string")).distinct().collect()]  # a few dates
        stored = scan_day_parquet(spark, points_dir, date_col=date_col).select(date_col).distinct()
        for day in days_to_refresh(arrived, [r[0] for r in stored.collect()], halo):
            process_day(spark, points_dir, day, flights, airports, out_dir, halo, date_col)
            if on_day:
                on_day(day)

    q = (stream.select(date_col).writeStream.foreachBatch(batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
