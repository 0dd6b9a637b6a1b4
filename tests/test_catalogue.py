"""Every query with SQL against DuckDB, order-insensitively; the others against closed forms."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import fields as fo
from gridloom.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def canonical(df):
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False, name=None):
        rows.append(tuple(None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x) + 0.0, 6) if isinstance(x, (float, np.floating)) else int(x) if isinstance(x, (int, np.integer)) and not isinstance(x, bool) else x for x in r))
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, con, small, name):
    got, want = QUERIES[name](spark, small), con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got.toPandas()), canonical(want.df())
    assert len(a) == len(b) and a
    assert a == b


def test_wiener_filter_solves_its_system(spark, tiny):
    from gridloom.operators.solvers import wiener_filter
    from gridloom.sources.fields import counts_hour

    counts = counts_hour(spark, tiny).df
    got = wiener_filter(counts.select("i", F.col("v").cast("double")), 0.05, 4.0, 720, iterations=25).toPandas().sort_values("i")["v"].to_numpy()
    data = QUERIES["mask_scatter"](spark, tiny)  # same domain
    assert len(got) == data.count() == 720
    n = 720
    a = np.diag(np.full(n, 2 * 0.05 + 0.25)) - 0.05 * (np.roll(np.eye(n), 1, 0) + np.roll(np.eye(n), -1, 0))
    d = counts.toPandas().sort_values("i")["v"].to_numpy(float)
    assert np.abs(a @ got - d / 4).max() < 1e-6


def test_smoothing_keeps_the_mean(spark, tiny):
    got = QUERIES["smooth_gaussian"](spark, tiny).groupBy("s").agg({"v": "sum"}).toPandas().set_index("s").iloc[:, 0]
    from gridloom.sources.fields import emb

    want = fo.contract(emb(spark, tiny), ["j"]).df.toPandas().set_index("s")["v"]
    assert np.abs(got.sort_index() - want.sort_index()).max() < 1e-9


def test_entry_imports_without_the_subpackage(tmp_path):
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    import shutil

    shutil.copytree(f"{here}/gridloom", tmp_path / "gridloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q)); assert 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert run.returncode == 0, run.stderr
