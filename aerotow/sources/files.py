"""File sources and sinks: CSV with R/pandas missing markers, day-partitioned
parquet, header-less delimited text, inline rows, models and metric logs."""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.nulls import clean_floats
from ..session import shared_path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return shared_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


# ------------------------------------------------------------------ sources

def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             null_value: str = "NA", nan_value: str = "NaN") -> DataFrame:
    """Header CSV; ``NA`` and empty fields are missing, ``NaN``/``Inf`` become null.

    Pass a schema for production reads; without one the types are inferred.
    """
    r = (spark.read.option("header", True).option("nullValue", null_value)
         .option("nanValue", nan_value).option("mode", "FAILFAST"))
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return clean_floats(r.csv(path))


def scan_delim_noheader(spark: SparkSession, path: str, names: Sequence[str], sep: str = ",",
                        schema: StructType | str | None = None, quote: str = '"', escape: str = "\\") -> DataFrame:
    """Header-less delimited text with column names assigned by position."""
    r = spark.read.option("header", False).option("sep", sep).option("quote", quote).option("escape", escape)
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", True).csv(path).toDF(*names)


def scan_table_file(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A dimension exported from a spreadsheet sheet (converted once to parquet
    or CSV; no spreadsheet reader is bundled), with an optional column pick."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else scan_csv(spark, path)
    return df.select(*columns) if columns else df


def scan_day_parquet(spark: SparkSession, path: str, days: Sequence[str] | None = None,
                     date_col: str = "file_date") -> DataFrame:
    """All day files under ``path`` in one read.

    A ``file_date=YYYY-MM-DD`` partition layout gives partition pruning for
    ``days``; flat files named ``YYYY-MM-DD*.parquet`` get the date from the
    first ten characters of the file name.
    """
    df = spark.read.parquet(path)
    if date_col not in df.columns:
        df = df.withColumn(date_col, F.substring(F.col("_metadata.file_name"), 1, 10))
    df = df.withColumn(date_col, F.col(date_col).cast("string"))
    if days is not None:
        df = df.where(F.col(date_col).isin(*list(days)))
    return df


def inline_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# -------------------------------------------------------------------- sinks

def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV without an index column; missing values written as NA."""
    df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)


def write_daily(df: DataFrame, path: str, date_col: str = "file_date") -> None:
    """Per-day results: only the days present in ``df`` are replaced (dynamic
    partition overwrite), so re-running a day is idempotent."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(path))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def log_metrics(spark: SparkSession, path: str, run: str, metrics: dict[str, float],
                params: dict | None = None) -> DataFrame:
    """Append one row per metric (run, time, name, value, params) to a parquet log."""
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    p = repr(sorted((params or {}).items()))
    df = spark.createDataFrame([(run, now, k, float(v), p) for k, v in metrics.items()],
                               "run string, logged_at timestamp_ntz, metric string, value double, params string")
    df.write.mode("append").parquet(path)
    return df
