"""Spark session helpers.

Library code never creates a session of its own; callers pass one in. The
builder below is for tests, the bench and command-line runs.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package assumes.  AQE re-plans joins at run time
# (shuffle join -> broadcast when a side turns out small, skewed partitions
# split) and coalesces the many small shuffle partitions of tiny inputs.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, partitions: int | None = None,
                  app: str = "aerotow") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    parts = partitions or int(os.environ.get("AEROTOW_SHUFFLE_PARTITIONS", "8"))
    b = SparkSession.builder.master(master).appName(app)
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    b = (b.config("spark.sql.shuffle.partitions", str(parts))
          .config("spark.driver.memory", os.environ.get("AEROTOW_DRIVER_MEMORY", "16g"))
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The folder is the one that ``spark.checkpoint.dir`` names; without the setting, the one that the caller gave to
    ``SparkContext.setCheckpointDir``. On a cluster one of them must be set, as a folder made here would be local to
    the driver; only a session in a single JVM (``local[...]``) gets a scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="aerotow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/aerotow/{name}"


#: Most buckets of a table; Spark takes no more than 100,000. A larger table has larger buckets.
MAX_BUCKETS = 50_000


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again; unlike a checkpoint, the planner knows its size."""
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, columns: str | list[str], buckets: int, name: str = "bucketed") -> DataFrame:
    """Write ``df`` once to the shared folder in hash buckets of ``columns`` and read it again.

    Later windows, groups and joins on them read a bucket per task and need no shuffle, and each of them reads
    only the columns and row groups that it uses. No session setting is touched. When ``df`` is already hash
    partitioned into as many partitions, every task writes a single file.
    """
    known_as = f"{name}_{uuid.uuid4().hex[:12]}"
    path = shared_path(df.sparkSession, known_as)
    first, *more = [columns] if isinstance(columns, str) else columns
    df.write.option("path", path).bucketBy(min(buckets, MAX_BUCKETS), first, *more).saveAsTable(known_as)
    return df.sparkSession.table(known_as)
