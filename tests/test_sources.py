import datetime as dt
import socket
import struct

import numpy as np
import pytest
from pyspark.sql import Observation

from flowmarrow.operators.flows import assemble_flows
from flowmarrow.schemas import PACKET_SCHEMA
from flowmarrow.sources import captures, readers, writers

CONN_LINE = "1704067207.179575\tC1\t10.0.0.1\t5353\t10.0.0.2\t80\ttcp\t-\t-\t100\t200\tSF\tT\tF\t0\tShAD\t5\t300\t10\t400\t(empty)"


def test_conn_log(spark, tmp_path):
    lines = ["#separator \\x09", "#fields\tts", CONN_LINE, "#close"]
    (tmp_path / "conn.log").write_text("\n".join(lines) + "\n")
    got = readers.read_conn_log(spark, str(tmp_path / "conn.log")).collect()
    assert len(got) == 1
    r = got[0]
    assert r["ts"] == dt.datetime(2024, 1, 1, 0, 0, 7, 179575)
    assert r["orig_h"] == "10.0.0.1" and r["orig_p"] == 5353 and r["duration"] is None and r["service"] is None
    assert r["local_orig"] is True and r["local_resp"] is False and r["tunnel_parents"] is None


def test_dropped_times_are_counted(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, None)], "id int, ts timestamp")
    seen = Observation()
    assert readers.drop_invalid_times(df, dropped=seen).count() == 1
    assert seen.get == {"rows": 2, "dropped": 1}


def test_folders_and_malformed_lines(spark, tmp_path):
    for folder, extra in (("logs_udp", "\tshort"), ("logs_other", "")):
        (tmp_path / folder).mkdir()
        text = f"{CONN_LINE}\t17\n" + (f"broken{extra}\n" if extra else "")
        (tmp_path / folder / "conn.log").write_text(text)
    (tmp_path / "logs_empty").mkdir()
    got = {r["folder"]: r["attack_type"] for r in readers.read_labelled_folders(spark, str(tmp_path)).collect() if r["uid"] == "C1"}
    assert got == {"logs_udp": "udp_flood", "logs_other": "normal"}


def test_written_log_has_a_header(spark, tmp_path):
    df = readers.rows_from_lists(spark, [[1, 2]], 2).selectExpr(
        "timestamp'2024-01-01 00:00:00' AS ts", "'a' AS orig_h", "1 AS orig_p", "'b' AS resp_h", "2 AS resp_p", "'tcp' AS proto"
    )
    path = tmp_path / "log"
    writers.write_conn_log(df.coalesce(1), str(path), ["ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto"])
    text = "".join(p.read_text() for p in sorted(path.glob("part-*")))
    assert "#fields\tts\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\n" in text
    assert "#types\ttime\taddr\tport\taddr\tport\tenum\n" in text
    assert "1704067200.000000\ta\t1\tb\t2\ttcp\n" in text and text.strip().endswith("#close")


def test_csv_checks(spark, tmp_path):
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(empty))
    odd = tmp_path / "odd.csv"
    odd.write_text("not,csv,content\nbroken\n")
    assert readers.read_csv(spark, str(odd)).columns == ["not", "csv", "content"]
    with pytest.raises(ValueError):
        readers.read_cicids(spark, str(odd))
    with pytest.raises(ValueError):
        readers.read_attack_log(spark, str(odd))
    with pytest.raises(ValueError):
        readers.load_connections(spark, "excel", str(odd))


def test_cicids(spark, tmp_path):
    f = tmp_path / "day.csv"
    f.write_text(" Flow Duration, Flow Bytes/s, Label\n1,Infinity,BENIGN\n2,NaN,DoS\n3,,Bot\n")
    got = [tuple(r) for r in readers.read_cicids(spark, str(f)).collect()]
    assert got == [(1.0, 0.0, 0), (2.0, 0.0, 1), (3.0, 0.0, 1)]


def test_attack_log_order(spark, tmp_path):
    f = tmp_path / "attacks.csv"
    f.write_text("start_time,end_time,attack_type\n2024-01-01 00:00:00,2024-01-01 01:00:00,a\n1704070800,1704074400,b\n")
    got = readers.read_attack_log(spark, str(f)).orderBy("interval_idx").collect()
    assert [(r["interval_idx"], r["attack_type"]) for r in got] == [(0, "a"), (1, "b")]
    assert got[1]["start_time"] == dt.datetime(2024, 1, 1, 1)


def test_metric_tables(spark, tmp_path):
    f = tmp_path / "m.csv"
    f.write_text("model,f1,note\nA,0.5,x\nB,nan,3\n")
    got = readers.read_metric_csv(spark, str(f)).collect()
    assert got[0]["f1"] == 0.5 and got[1]["f1"] is None and got[1]["note"] == 3.0
    df = spark.createDataFrame([('{"A": {"f1": 0.5}, "B": {"f1": 0.25}}',)], "value string")
    rows = {r["model"]: r["f1"] for r in readers.metrics_from_json(df, "value", ["f1"]).collect()}
    assert rows == {"A": 0.5, "B": 0.25}


def test_inline_rows(spark):
    row = [0, 100, 200, 5, 10, 300, 15, 0.5, 0.5, 0.1, 0.2, 2]
    assert readers.rows_from_lists(spark, [row], 12).first()["features"][1] == 100.0
    for bad in ([], [[1, 2]], [[1] * 11 + ["x"]], [row, row[:3]]):
        with pytest.raises(ValueError):
            readers.rows_from_lists(spark, bad, 12)


def frame(src, dst, proto, sport=0, dport=0, flags=0, size=0):
    if proto == 6:
        body = struct.pack("!HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 0, 0, 0)
    elif proto == 17:
        body = struct.pack("!HHHH", sport, dport, 8, 0)
    else:
        body = b"\x08\x00\x00\x00"
    body += b"x" * size
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, socket.inet_aton(src), socket.inet_aton(dst))
    return b"\0" * 12 + b"\x08\x00" + ip + body


def capture(frames, order="<"):
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for t, f in frames:
        out += struct.pack(order + "IIII", int(t), round(t % 1 * 1e6), len(f), len(f)) + f
    return out


def test_captures(spark, tmp_path):
    arp = b"\0" * 12 + b"\x08\x06" + b"\0" * 28
    frames = [
        (100.5, frame("10.0.0.1", "10.0.0.2", 6, 1234, 80, 2)),
        (101.0, frame("10.0.0.1", "10.0.0.2", 6, 1234, 80, 16, 10)),
        (102.0, frame("10.0.0.3", "10.0.0.2", 17, 53, 53)),
        (103.0, frame("10.0.0.3", "10.0.0.2", 1)),
        (104.0, arp),
    ]
    (tmp_path / "a.pcap").write_bytes(capture(frames))
    (tmp_path / "b.pcap").write_bytes(capture(frames[:1], ">") + b"\0" * 7)
    got = captures.read_packets(spark, str(tmp_path)).orderBy("ts", "proto").collect()
    assert len(got) == 6
    r = got[0]
    assert (r["src_ip"], r["sport"], r["dst_ip"], r["dport"], r["proto"], r["tcp_flags"]) == ("10.0.0.1", 1234, "10.0.0.2", 80, "tcp", 2)
    assert r["ts"] == dt.datetime(1970, 1, 1, 0, 1, 40, 500000) and r["length"] == len(frames[0][1])
    assert [x["proto"] for x in got] == ["tcp", "tcp", "tcp", "udp", "icmp", "other"] and got[-1]["is_ip"] is False
    flows = assemble_flows(captures.read_packets(spark, str(tmp_path))).collect()
    assert sorted(f["orig_pkts"] for f in flows) == [1, 1, 3]


def test_broken_capture(spark, tmp_path):
    (tmp_path / "c.pcap").write_bytes(b"")
    with pytest.raises(ValueError):
        captures.read_packets(spark, str(tmp_path))
    (tmp_path / "c.pcap").write_bytes(b"not a capture at all, whatever its name")
    with pytest.raises(Exception, match="not a packet capture"):
        captures.read_packets(spark, str(tmp_path)).count()


def many_frames(n, seed=0):
    """Frames of all kinds, among them packets that carry a whole capture."""
    rng = np.random.default_rng(seed)
    tcp = lambda body: bytes(12) + b"\x08\x00" + struct.pack("!BBHHHBBH4s4s", 0x45, 0, 40 + len(body), 0, 0, 64, 6, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + struct.pack("!HHIIBBHHH", 1, 2, 0, 0, 0x50, 2, 0, 0, 0) + body
    inner = capture([(1_700_000_000.0 + i, tcp(b"x" * 5)) for i in range(8)])[24:]
    bodies = [b"", bytes(30), inner, rng.bytes(900), bytes(1200)]
    frames = []
    for i in range(n):
        kind = i % 7
        frame = rng.bytes(int(rng.integers(1, 60))) if kind == 0 else tcp(bodies[int(rng.integers(0, 5))])
        frames.append((1_700_000_000.0 + i / 10, frame))
    return frames


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tail", [b"", b"\0" * 9, struct.pack("<IIII", 1_700_000_500, 1, 900, 900) + b"short"])
def test_captures_by_byte_ranges(spark, tmp_path, order, tail):
    """Every cut gives the packets of the whole file, once each."""
    if order == ">" and len(tail) > 9:
        tail = struct.pack(">IIII", 1_700_000_500, 1, 900, 900) + b"short"
    content = capture(many_frames(300), order) + tail
    (tmp_path / "a.pcap").write_bytes(content)
    whole = [tuple(r) for r in captures.read_packets(spark, str(tmp_path)).collect()]
    assert len(whole) == 300
    reader = lambda step: captures.CaptureReader(str(tmp_path), step)
    expected = pa_rows(reader(1 << 30))
    for step in (900, 7777, 50_000):
        assert len(reader(step).partitions()) == -(-len(content) // step)
        assert pa_rows(reader(step)) == expected
    assert sorted(map(str, captures.read_packets(spark, str(tmp_path), 5000).collect())) == sorted(str(r) for r in captures.read_packets(spark, str(tmp_path)).collect())


def pa_rows(reader):
    return [tuple(r.values()) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]


def test_a_cut_that_cannot_be_proven_fails(tmp_path):
    """A clock that jumps by decades looks like no record; the neighbouring task notices that one was passed over."""
    frames = [(1_700_000_000.0 + i, b"" if i % 3 == 0 else b"y" * 400) for i in range(900)]
    (tmp_path / "a.pcap").write_bytes(capture(frames))
    reader = lambda step: captures.CaptureReader(str(tmp_path), step)
    assert len(pa_rows(reader(1 << 30))) == 900 and pa_rows(reader(20_011)) == pa_rows(reader(1 << 30))
    frames = [(1.0 if i % 100 == 0 and i else t, f) for i, (t, f) in enumerate(frames)]
    (tmp_path / "a.pcap").write_bytes(capture(frames))
    assert len(pa_rows(reader(1 << 30))) == 900
    with pytest.raises(ValueError, match="cannot be cut"):
        pa_rows(reader(20_011))


def test_very_many_ranges_grow(tmp_path, monkeypatch):
    (tmp_path / "a.pcap").write_bytes(capture(many_frames(300)))
    reader = lambda step: captures.CaptureReader(str(tmp_path), step)
    expected = pa_rows(reader(1 << 30))
    monkeypatch.setattr(captures, "RANGES", 10)
    assert len(reader(500).partitions()) == 10 and pa_rows(reader(500)) == expected
    monkeypatch.setattr(captures, "RANGE_BYTES", 900)
    assert max(r.end - r.start for r in reader(500).partitions()) == 900


def test_labelled_folders_join_once(spark, tmp_path, monkeypatch):
    """What is written to each folder is read from a table, not joined again."""
    from flowmarrow.plans import io_queries

    plans, write = [], writers.write_conn_log

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, *args)

    monkeypatch.setattr(writers, "write_conn_log", seen)
    kinds = ["view", "error", "click", "signup", "purchase"]
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), i % 4, kinds[i % 5], float(i), f'{{"k": {i}}}') for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert io_queries.labelled_folders(spark, str(tmp_path)).count() == 40
    assert len(plans) == 5 and not any("Join" in p for p in plans)


def test_written_captures(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, 0, i, 5), "1.2.3.4", i, "5.6.7.8", 80, "tcp" if i % 2 else "udp", 60 + i, i if i % 2 else None, True) for i in range(50)]
    rows += [(dt.datetime(2024, 1, 1), None, None, None, None, "other", 20, None, False), (dt.datetime(2024, 1, 1), "9.9.9.9", 0, "8.8.8.8", 0, "icmp", 98, None, True)]
    captures.write_packets(spark.createDataFrame(rows, PACKET_SCHEMA).repartition(2), f"{tmp_path}/out")
    back = captures.read_packets(spark, f"{tmp_path}/out", 500).collect()
    assert sorted(map(str, map(tuple, back))) == sorted(map(str, rows))
    assert len(list((tmp_path / "out").glob("*.pcap"))) == 2 and not list((tmp_path / "out").glob("*.open"))


def test_logs_with_different_columns_are_refused(spark, tmp_path):
    for name, fields in (("a.log", "uid\tproto"), ("b.log", "proto\tuid")):
        (tmp_path / name).write_text(f"#separator \\x09\n#fields\t{fields}\nx\ty\n")
    with pytest.raises(ValueError):
        readers.read_conn_log_with_header(spark, str(tmp_path))
    assert readers.read_conn_log_with_header(spark, str(tmp_path / "b.log")).first()["proto"] == "x"
