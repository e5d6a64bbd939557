"""Every registered query against its DuckDB oracle (rows, columns, values).

The default run checks a core set at sf0.001; AEROTOW_FULL_ORACLE=1 checks
every query that has an oracle (sf chosen by AEROTOW_ORACLE_SF).
"""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from aerotow.sources.tables import TABLES

CORE = ["trajectory_features", "trajectory_features_hot", "sticky_phase", "traj_phase_initial", "time_features", "duration_features",
        "region_features", "qcut_lineitem", "airport_geometry", "dedupe_key_first", "missing_profile",
        "describe_lineitem", "correlation_lineitem", "histogram_price", "label_encode", "one_hot_align",
        "running_mean_table", "ffill_table", "clean_fill", "blend_weights", "classification_metrics",
        "csv_roundtrip", "halo_days"]
SF = os.environ.get("AEROTOW_ORACLE_SF", "/root/testdata/sf0.001")
ALL = sorted(entry.oracle_sql()) if os.environ.get("AEROTOW_FULL_ORACLE") else CORE


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_a_callable_and_oracle_keys_are_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 75


@pytest.mark.parametrize("name", ALL)
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF).toPandas()
    ddf = duck.execute(entry.oracle_sql()[name]).df()
    sc, sr = _rows(sdf)
    dc, dr = _rows(ddf)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 106
    assert df.count() > 0
