"""Every query that has SQL gives the rows of DuckDB on the smallest tables."""

import glob
import importlib
import math
import os

import duckdb
import pytest

MODULES = ["preparation", "temporal", "spectral", "pictures", "tables", "streams", "composites"]
CASES = [(m, k) for m in MODULES for k in importlib.import_module(f"chirpline.plans.{m}").ORACLES]
PLANS = {m: importlib.import_module(f"chirpline.plans.{m}") for m in MODULES}
OTHERS = [(m, k) for m in MODULES for k in PLANS[m].QUERIES if k not in PLANS[m].ORACLES]


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in glob.glob(data + "/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("module, name", CASES)
def test_same_rows(spark, data, duck, module, name):
    plan = importlib.import_module(f"chirpline.plans.{module}")
    df = plan.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rel = duck.sql(plan.ORACLES[name])
    assert columns == sorted(rel.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    want = sorted(tuple(map(plain, r)) for r in rel.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert len(got) == len(want)
    close = [all(a == b or abs(float(a) - float(b)) <= 2e-6 * max(1, abs(float(b))) for a, b in zip(x, y)) if x != y else True for x, y in zip(got, want)]
    assert all(close)


@pytest.mark.parametrize("module, name", OTHERS)
def test_runs(spark, data, module, name):
    df = importlib.import_module(f"chirpline.plans.{module}").QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
