import datetime as dt

import numpy as np

from flowmarrow.operators import flows as fl
from flowmarrow.schemas import FEATURES, PACKET_SCHEMA, WINDOW_FEATURES

T0 = dt.datetime(2024, 1, 1)
AT = lambda s: T0 + dt.timedelta(seconds=float(s))


def packets(spark, rows):
    """rows: (seconds, src, length, proto, flags)"""
    data = [(AT(s), src, 1, "d", 2, proto, n, flags, src is not None) for s, src, n, proto, flags in rows]
    return spark.createDataFrame(data, PACKET_SCHEMA)


def test_idle_gap(spark):
    base = [(0, "a", 10, "tcp", 2), (60, "a", 10, "tcp", 0), (121, "a", 5, "tcp", 0)]
    whole = fl.assemble_flows(packets(spark, base)).collect()
    assert len(whole) == 1 and whole[0]["orig_bytes"] == 25 and whole[0]["orig_pkts"] == 3
    cut = fl.assemble_flows(packets(spark, base), 60.0).orderBy("ts_start").collect()
    assert [(r["orig_pkts"], r["orig_bytes"]) for r in cut] == [(2, 20), (1, 5)]


def test_sessions_against_brute_force(spark):
    rng = np.random.default_rng(2)
    times = np.round(np.cumsum(rng.exponential(25, 500)), 3)
    rows = [(t, "ab"[int(rng.integers(0, 2))], 1, "udp", None) for t in times]
    got = fl.assemble_flows(packets(spark, rows), 60.0)
    found = {(r["orig_h"], r["ts_start"], r["ts_end"], r["orig_pkts"]) for r in got.collect()}
    want = set()
    for h in "ab":
        group = []
        for t, src, *_ in rows:
            if src != h:
                continue
            if group and t - group[-1] > 60.0:
                want.add((h, AT(group[0]), AT(group[-1]), len(group)))
                group = []
            group.append(t)
        want.add((h, AT(group[0]), AT(group[-1]), len(group)))
    assert found == want


def test_flow_features(spark):
    flows = fl.assemble_flows(packets(spark, [(0, "a", 10, "tcp", 2), (4, "a", 20, "tcp", 2)]))
    got = fl.flow_features(flows).first()
    assert got["duration"] == 4.0 and got["total_bytes"] == 30.0 and got["bytes_ratio"] == 0.0
    assert [c for c in fl.flow_features(flows, ["zzz", *FEATURES[:2]]).columns[-3:]] == ["zzz", "duration", "orig_bytes"]


def test_window_statistics(spark):
    rows = [(0, "a", 10, "tcp", 2), (1, "b", 30, "tcp", 16), (4.9, "a", 20, "udp", None), (5, "a", 7, "icmp", None), (6, None, 60, "other", None)]
    got = fl.packet_window_stats(packets(spark, rows)).orderBy("window_start").collect()
    first = got[0]
    assert (first["total_packets"], first["total_bytes"], first["unique_src"], first["unique_dst"]) == (3, 60.0, 2, 1)
    np.testing.assert_allclose([first["std_size"], first["syn_ratio"], first["tcp_ratio"]], [np.std([10, 30, 20]), 1 / 3, 2 / 3])
    assert got[1]["total_packets"] == 2 and got[1]["unique_src"] == 1 and got[1]["other_ratio"] == 1.0


def test_no_packets(spark):
    got = fl.packet_stats(packets(spark, []))
    assert tuple(got.first()) == (0,) + (0.0,) * 4 + (0, 0) + (0.0,) * 5
    assert got.columns == WINDOW_FEATURES


def test_packets_as_connections(spark):
    got = fl.packets_to_connections(packets(spark, [(0.5, "a", 10, "tcp", 2), (1, None, 9, "other", None)])).collect()
    assert len(got) == 1 and got[0]["conn_state"] == "S0" and got[0]["ts"] == 1704067200.5


def test_oldest_tenth(spark):
    rows = [(i, f"h{i:02d}", 1, "tcp", 0) for i in range(20)]
    got = fl.oldest_tenth(fl.assemble_flows(packets(spark, rows)))
    assert {r["orig_h"] for r in got.collect()} == {"h00", "h01"}
