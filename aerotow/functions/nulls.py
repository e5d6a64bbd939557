"""Missing-value rules.

NaN and +/-Inf become null on ingest and after every division, so that
aggregates and exact percentiles never see them (Spark orders NaN above every
number, which would silently move medians).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """x if it is a finite number, else null."""
    x = _c(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def magnitude_mask(x, threshold: float = 1e10) -> Column:
    """x if finite and |x| <= threshold, else null."""
    x = _c(x)
    return F.when(~F.isnan(x) & (F.abs(x) <= F.lit(threshold)), x)


def safe_div(a, b) -> Column:
    """a / b with null for a zero divisor (ANSI mode would raise)."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def nullif_zero(x) -> Column:
    x = _c(x)
    return F.when(x != 0, x)


def r_ifelse(cond: Column, yes, no) -> Column:
    """ifelse() with R's missing-value rule: a null condition gives null."""
    return F.when(cond, yes).when(cond.isNull(), F.lit(None)).otherwise(no)


def clean_floats(df: DataFrame) -> DataFrame:
    """Replace NaN/Inf by null in every floating column (ingest rule)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(finite(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
