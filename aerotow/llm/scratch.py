"""Intermediate tables in the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_path


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_path(spark, 'llm')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Like :func:`written`, in hash buckets of ``column``: joins and groups by it then need no shuffle of the table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    known_as = "llm_" + path.rsplit("/", 1)[1].replace("-", "_")
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(known_as)
    return spark.table(known_as)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files of a table, from the file system that Spark reads it with."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).getContentSummary(p).getLength()
