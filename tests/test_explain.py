import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from flowmarrow.operators import explain as ex
from flowmarrow.sources import writers

NAMES = [
    "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "bytes_ratio", "pkts_ratio",
    "throughput", "proto", "service", "conn_state", "total_bytes",
]
ORIGINAL = [100, 50000, 1000, 500, 50, 50, 10, 500, 1, 2, 1, 51000]
EXPECTED = [10, 5000, 5000, 50, 50, 1, 1, 50, 1, 2, 1, 10000]


def one(spark, original=ORIGINAL, expected=EXPECTED):
    row = (1, dt.datetime(2024, 1, 1), [float(v) for v in original], [float(v) for v in expected], "10.0.0.1")
    return spark.createDataFrame([row], "conn_id long, ts timestamp, original array<double>, expected array<double>, src string")


def test_worked_example(spark):
    r = ex.explain(one(spark), NAMES, 0.001, info=["src"]).first()["explanation"]
    assert r["severity"] == "CRITICAL"
    assert [f["name"] for f in r["anomalous_features"]] == ["orig_bytes", "total_bytes", "resp_bytes"]
    errors = [abs(a - b) for a, b in zip(ORIGINAL, EXPECTED)]
    mean = sum(errors) / 12
    assert r["anomaly_score"] == pytest.approx(mean)
    assert r["anomalous_features"][0]["contribution_percent"] == pytest.approx(45000 / mean * 100)
    # two features lie above mean + deviation: 50 + 2/12 * 30 + 20
    assert r["priority_score"] == 75
    assert [a["priority"] for a in r["recommended_actions"]] == ["HIGH"] * 3 + ["MEDIUM"] * 3
    assert [s["step"] for s in r["investigation_steps"]] == [1, 2, 3, 4, 5, 6]
    assert r["investigation_steps"][4]["details"] == ex.UNKNOWN_FEATURE
    assert r["potential_threats"][:3] == ["Data theft", "Database dump", "File upload"]
    assert r["connection_info"] == {"src": "10.0.0.1"}


def test_no_error_at_all(spark):
    r = ex.explain(one(spark, EXPECTED, EXPECTED), NAMES, 0.001).first()
    assert r["severity"] == "UNKNOWN" and r["priority_score"] == 0
    assert {f["contribution_percent"] for f in r["anomalous_features"]} == {0.0}


def alerts(spark, rows):
    return spark.createDataFrame(rows, "conn_id long, ts timestamp, priority_score int")


def test_alert_filter(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(seconds=i), 60 + i % 7) for i in range(40)]
    rows += [(99, t + dt.timedelta(hours=3), 55), (100, t, 10)]
    got = {r["conn_id"] for r in ex.filter_alerts(alerts(spark, rows), max_per_hour=20, keep=5).collect()}
    calm = set(range(19)) | {99}
    busy = sorted(range(19, 40), key=lambda i: (-(60 + i % 7), i))[:5]
    assert got == calm | set(busy)


def test_alert_filter_keeps_some_of_every_busy_hour(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(h * 100 + i, t + dt.timedelta(hours=5 * h, seconds=i), 60 + i % 7) for h in range(4) for i in range(50)]
    found = ex.filter_alerts(alerts(spark, rows), max_per_hour=20, keep=5).collect()
    for h in range(4):
        late = [r for r in found if r["conn_id"] // 100 == h and r["conn_id"] % 100 >= 19]
        best = sorted(range(19, 50), key=lambda i: (-(60 + i % 7), i))[:5]
        assert sorted(r["conn_id"] % 100 for r in late) == sorted(best) and {r["suppressed"] for r in late} == {26}


def test_deduplication_and_report(spark):
    base = one(spark)
    rows = base.unionByName(base.withColumn("conn_id", F.lit(2).cast("long")))
    done = ex.explain(rows, NAMES, 0.001)
    best = ex.deduplicate_alerts(done.select("conn_id", "priority_score", "anomalous_features")).collect()
    assert len(best) == 1 and best[0]["similar_alerts_count"] == 2 and best[0]["conn_id"] == 1
    head = ex.alert_summary(done).first()
    assert head["total_anomalies"] == 2 and head["severity_distribution"] == {"CRITICAL": 2}
    assert head["top_anomalous_features"] == {"orig_bytes": 2, "total_bytes": 2, "resp_bytes": 2}
    board = ex.dashboard(done).first()
    assert board["top_feature"] == "orig_bytes" and board["top_threat"] == "Data theft"


def test_alert_report_is_sorted_as_numbers_and_compressed(spark, tmp_path):
    base = one(spark)
    rows = base
    for k in range(2, 9):
        rows = rows.unionByName(base.withColumns({"conn_id": F.lit(k).cast("long"), "expected": F.zip_with("original", "expected", lambda o, e: o + (e - o) / 10**k)}))
    done, sorted_first = ex.explain(rows, NAMES, 0.5), ex.explain(rows, NAMES, 0.5, urgent_first=True)
    writers.write_alert_report(done, f"{tmp_path}/a", sorted_first)
    writers.write_alert_report(done, f"{tmp_path}/b")
    read = lambda x: [line for p in sorted((tmp_path / x / "alerts").glob("part-*.gz")) for line in gzip.decompress(p.read_bytes()).decode().splitlines()]
    assert len(read("a")) == 8 and sorted(read("a")) == sorted(read("b"))
    order = [json.loads(line)["priority_score"] for line in read("a")]
    assert order == sorted(order, reverse=True) and len(set(order)) > 1
    plan = sorted_first.select("explanation")._jdf.queryExecution().executedPlan().toString().splitlines()
    sort = next(i for i, line in enumerate(plan) if "rangepartitioning(priority_score" in line)
    assert any("anomalous_features" in line for line in plan[:sort]) and not any("anomalous_features" in line for line in plan[sort:])


def test_filter_does_not_repeat_the_work(spark):
    done = ex.explain(one(spark), NAMES, 0.001).filter("priority_score >= 50")
    plan = done._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter (" in line]
    assert all("zip_with" not in line for line in filters)
