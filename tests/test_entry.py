"""The driver's contract: queries run, and agree with their SQL."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df):
    out = []
    for r in df.astype(object).where(df.notna(), None)[sorted(df.columns)].values.tolist():
        out.append(tuple(round(x, 6) + 0.0 if isinstance(x, float) else (str(x) if isinstance(x, bool) else x) for x in r))
    return sorted(out, key=str)


def _names():
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from algoscape.plans.queries import ORACLE

    return sorted(ORACLE)


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, tables, name):
    import __spark_entry__ as e

    got, want = e.queries()[name](spark, SF).toPandas(), tables.sql(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-6) if all(isinstance(v, (int, float)) for v in x) else x == y


def test_index_reaches_the_last_row(spark, monkeypatch):
    from algoscape.plans import queries as q

    monkeypatch.setattr(q, "view", lambda s, d, name: s.range(1_000_010).select(F.col("id").cast("string").alias("instances")))
    monkeypatch.setattr(q.M, "with_row_id", lambda df: df.withColumn("row_id", F.col("instances").cast("long") + 1))
    assert q.QUERIES["index_subset"](spark, "").count() == 333_337


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    assert e.entry(spark).count() > 0


def test_without_training_data_operators(tmp_path):
    """The rest works when the optional folders and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    shutil.rmtree(copy / "algoscape" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'zscore' in q and not any(x.startswith('op') or x == 'pipeline' for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
