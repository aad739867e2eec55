"""A sample of the catalogue against its SQL; tools/check_queries.py runs all of it."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
SF = "/root/testdata/sf0.001"
SAMPLE = [
    "conn_features_12", "host_sequences", "interval_ip_label", "flow_sessions_60s", "class_report", "roc_auc",
    "thr_compare", "drift_by_window", "ensemble_compare", "explain_all", "alert_filter", "kfold", "stream_windows",
]

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    from check_queries import TABLES

    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, db, name):
    import __spark_entry__ as entry
    from check_queries import rows_of

    df = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_catalogue():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_workers_need_no_package(tmp_path):
    """Python tasks run although only the driver can import the package."""
    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
import __spark_entry__ as entry
from flowmarrow import session
spark = session("elsewhere", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
spark.sparkContext.setLogLevel("OFF")
print("rows", entry.queries()["conn_log_roundtrip"](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1000" in done.stdout, done.stderr[-2000:]
