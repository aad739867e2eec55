import datetime as dt

import numpy as np
import pytest

from flowmarrow.operators import labeling as lb
from flowmarrow.operators import ordered

T0 = dt.datetime(2024, 1, 1)
AT = lambda s: T0 + dt.timedelta(seconds=s)
LOG = "interval_idx int, attack_type string, source_ip string, target_ip string, start_time timestamp, end_time timestamp"


def rows(spark, seconds, orig="o", resp="r"):
    data = [(i, AT(s) if s is not None else None, orig, resp) for i, s in enumerate(seconds)]
    return spark.createDataFrame(data, "conn_id long, ts timestamp, orig_h string, resp_h string")


@pytest.fixture(params=["broadcast", "shuffled", "crowded"])
def way(request, monkeypatch):
    """Rows that do not move, rows that meet their cells by a shuffle, and cells that have to be divided."""
    if request.param != "broadcast":
        monkeypatch.setattr(ordered, "BROADCAST_ROWS", 0)
    if request.param == "crowded":
        monkeypatch.setattr(lb, "CELL_SEGMENTS", 1)
        monkeypatch.setattr(lb, "LONG_BLOCK", 2)


def test_closed_interval_and_last_wins(spark, way):
    log = spark.createDataFrame(
        [(0, "first", None, None, AT(10), AT(20)), (1, "second", None, None, AT(15), AT(30)), (2, "bad", None, None, AT(9), AT(1))],
        LOG,
    )
    df = rows(spark, [9, 10, 14, 15, 20, 30, 31, None])
    got = lb.label_by_intervals(df, log).orderBy("conn_id").collect()
    kinds = ["normal", "first", "first", "second", "second", "second", "normal", "normal"]
    assert [r["attack_type"] for r in got] == kinds
    assert [r["label"] for r in got] == ["normal" if k == "normal" else "anomaly" for k in kinds]


def test_hosts_against_brute_force(spark, way):
    rng = np.random.default_rng(7)
    hosts = ["a", "b", "c", None]
    pick = lambda: hosts[int(rng.integers(0, 4))]
    log = []
    for i in range(25):
        s = int(rng.integers(0, 500))
        log.append((i, f"t{i}", pick(), pick(), AT(s), AT(s + int(rng.integers(0, 120)))))
    conns = [(i, AT(int(rng.integers(0, 600))), pick(), pick()) for i in range(400)]
    df = spark.createDataFrame(conns, "conn_id long, ts timestamp, orig_h string, resp_h string")
    got = lb.label_by_intervals(df, spark.createDataFrame(log, LOG), match_hosts=True)
    found = {r["conn_id"]: r["attack_type"] for r in got.collect()}
    assert len(found) == 400
    for i, ts, orig, resp in conns:
        want = "normal"
        for _, kind, src, dst, s, e in log:
            hit = src is None or (orig is not None and orig == src) or (resp is not None and resp == dst)
            if s <= ts <= e and hit:
                want = kind
        assert found[i] == want


def test_thousands_of_intervals_from_one_instant(spark):
    """A dense instant, nested intervals and long ones over all of them, against a running count of open intervals."""
    rng = np.random.default_rng(11)
    log = [(i, f"t{i}", None, None, AT(100), AT(100 + (i * 37) % 400)) for i in range(2000)]
    log += [(2000 + i, f"t{i}", None, None, AT(int(a)), AT(int(a) + int(b))) for i, (a, b) in enumerate(rng.integers(0, 700, (1500, 2)))]
    log += [(-1, "whole", None, None, AT(0), AT(2000))]
    df = rows(spark, range(0, 1500, 3))
    got = {r["conn_id"]: r["attack_type"] for r in lb.label_by_intervals(df, spark.createDataFrame(log, LOG)).collect()}
    for i, second in enumerate(range(0, 1500, 3)):
        open_ = [(idx, kind) for idx, kind, _, _, s, e in log if s <= AT(second) <= e]
        assert got[i] == max(open_)[1]


def test_disjoint_segments_do_not_overlap(spark):
    log = spark.createDataFrame([(i, "t", f"h{i % 3}", "z", AT(i % 17), AT(i % 17 + i % 23)) for i in range(200)], LOG)
    got = lb._disjoint(lb._prepared(log, True)).orderBy("side", "host", "s").collect()
    assert {(r.side, r.host) for r in got} == {(1, "h0"), (1, "h1"), (1, "h2"), (2, "z")}
    assert all((a.side, a.host) != (b.side, b.host) or a.e < b.s for a, b in zip(got, got[1:]))


def test_no_log_is_all_normal(spark):
    df = rows(spark, [1, 2])
    assert {r["label"] for r in lb.all_normal(df).collect()} == {"normal"}
    empty = spark.createDataFrame([], LOG)
    assert {r["label"] for r in lb.label_by_intervals(df, empty).collect()} == {"normal"}


def test_folders(spark):
    df = spark.createDataFrame([("logs_syn",), ("logs_new",)], "folder string")
    got = {r["folder"]: (r["label"], r["attack_type"]) for r in lb.label_by_folder(df).collect()}
    assert got == {"logs_syn": ("anomaly", "syn_flood"), "logs_new": ("normal", "normal")}


def test_dataset_labels(spark):
    df = spark.createDataFrame([("Normal",), (None,), ("Worms",)], "attack_cat string")
    got = [(r["label"], r["attack_type"]) for r in lb.label_from_dataset(df).collect()]
    assert got == [("normal", "normal"), ("normal", "normal"), ("anomaly", "Worms")]
    plain = lb.label_from_dataset(spark.range(1)).first()
    assert (plain["label"], plain["attack_type"]) == ("normal", "normal")


def test_unsw_without_times(spark):
    df = spark.createDataFrame([(30, "1.5", 1), (10, "2", 0), (20, "3", 0)], "row long, dur string, label int")
    got = lb.unsw_to_connections(df, "row").orderBy("row").collect()
    assert [r["ts"] for r in got] == [AT(0), AT(1), AT(2)]
    assert [r["label"] for r in got] == ["normal", "normal", "anomaly"]
    assert got[0]["history"] == "-" and got[0]["orig_bytes"] == 0
    with pytest.raises(ValueError):
        lb.unsw_to_connections(df)


def test_targets(spark):
    df = spark.createDataFrame([("BENIGN",), ("DoS",)], "l string")
    assert [r["y"] for r in lb.binary_target(df, "l", "BENIGN").collect()] == [0, 1]
    odd = spark.createDataFrame([("1", "x"), (" Attack", "x"), ("0", "x")], "` LABEL ` string, z string")
    assert [r["y"] for r in lb.truth_column(odd).collect()] == [1, 1, 0]
    with pytest.raises(ValueError):
        lb.truth_column(spark.range(1))
    assert lb.resolve_column(odd, lb.LABEL_CANDIDATES) == " LABEL "
    assert lb.only_normal(spark.createDataFrame([("normal",), ("anomaly",)], "label string")).count() == 1


def test_label_header_in_any_case(spark):
    df = spark.createDataFrame([(0, "1", "Fuzzers"), (1, "0", "Normal")], "stime long, Label string, ATTACK_CAT string")
    got = lb.unsw_to_connections(df).orderBy("ts").collect()
    assert [(r["label"], r["attack_type"]) for r in got] == [("anomaly", "Fuzzers"), ("normal", "normal")]
