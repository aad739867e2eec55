import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmarrow.functions import columns as c
from flowmarrow.operators import features as ft
from flowmarrow.schemas import FEATURES

SCHEMA = (
    "conn_id long, ts timestamp, orig_h string, orig_p int, resp_h string, resp_p int, "
    "duration string, orig_bytes string, resp_bytes string, orig_pkts string, resp_pkts string"
)
T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def conns(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(i, host="a", sport=1, dport=1, sec=0, dur="1", ob="10", rb="5", op="2", rp="1"):
    ts = None if sec is None else T0 + dt.timedelta(seconds=sec)
    return (i, ts, host, sport, "r", dport, dur, ob, rb, op, rp)


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def test_all_features(spark):
    df = conns(
        spark,
        [
            row(0, "a", 80, 1, 0, dur="-"),
            row(1, "a", 80, 1, 30, rb="0"),
            row(2, "a", 443, 2, 59),
            row(3, "a", 443, 2, 61),
            row(4, "b", 9, 9, 0),
            row(5, None, 9, 9, 0),
            row(6, "b", None, 9, None, rp="0"),
        ],
    )
    got = {r["conn_id"]: r for r in ft.feature_matrix(ft.connection_features(df), ["conn_id"]).collect()}
    assert list(got[0].asDict())[1:] == FEATURES
    assert got[0]["duration"] == 0.0
    assert got[1]["bytes_ratio"] == 0.0 and got[2]["bytes_ratio"] == 2.0
    assert got[0]["src_port_entropy"] == pytest.approx(1.0) and got[0]["dst_port_entropy"] == pytest.approx(1.0)
    assert [got[i]["connections_per_min"] for i in range(4)] == [3, 3, 3, 1]
    assert got[4]["src_port_entropy"] == 0.0
    # no host: no entropy and no rate; no time: no rate
    assert got[5]["src_port_entropy"] == 0.0 and got[5]["connections_per_min"] == 0.0
    assert got[6]["connections_per_min"] == 0.0 and got[6]["pkts_ratio"] == 0.0


def test_entropy_against_numpy(spark):
    rng = np.random.default_rng(1)
    ports = rng.integers(0, 12, 400)
    df = spark.createDataFrame([("h", int(p), 1) for p in ports], "orig_h string, orig_p int, resp_p int")
    p = np.bincount(ports) / len(ports)
    got = ft.port_entropy(df).first()
    assert got["src_port_entropy"] == pytest.approx(-(p[p > 0] * np.log2(p[p > 0])).sum())
    assert got["dst_port_entropy"] == 0.0 and got["n_conns"] == 400


def test_alignment(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    got = ft.align_columns(df, ["b", "z", "a"])
    assert got.columns == ["b", "z", "a"] and tuple(got.first()) == (0.0, 0.0, 1.0)
    assert ft.missing_columns(df, ["a", "z"]) == ["z"]
    with pytest.raises(ValueError):
        ft.align_columns(df, ["x", "y"])
    with pytest.raises(ValueError):
        ft.feature_matrix(df)


def test_numeric_only(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "i int, s string, d double")
    assert ft.numeric_only(df).columns == ["i", "d"]


@pytest.mark.parametrize(
    "text, want",
    [("1704103200", T0), ("1704103200.25", T0.replace(microsecond=250000)), ("2024-01-01 10:00:00", T0), ("-", None), ("NaN", None)],
)
def test_timestamps(spark, text, want):
    assert one(spark, c.timestamp_of(F.lit(text))) == want


def test_last_microsecond_survives(spark):
    assert one(spark, F.unix_micros(c.timestamp_of(F.lit("1704067207.179575")))) == 1704067207179575


@pytest.mark.parametrize("text, want", [("-", 0), ("NaN", 0), ("inf", 0), ("-Infinity", 0), ("2e12", 1e9), ("-2e12", -1e9), ("3.5", 3.5)])
def test_clipping(spark, text, want):
    assert one(spark, c.clipped_finite(F.lit(text))) == want


@pytest.mark.parametrize("ratio, want", [(0.9, "UNKNOWN"), (1, "LOW"), (1.5, "MEDIUM"), (3, "HIGH"), (5, "CRITICAL")])
def test_severity(spark, ratio, want):
    assert one(spark, c.severity(F.lit(float(ratio)))) == want


@pytest.mark.parametrize("score, want", [(0.29, "normal"), (0.3, "suspicious"), (0.7, "anomalous")])
def test_bands(spark, score, want):
    assert one(spark, c.score_band(F.lit(score))) == want


def test_syn_bit(spark):
    assert one(spark, c.has_syn(F.lit(18))) is True
    assert one(spark, c.has_syn(F.lit(16))) is False
    assert one(spark, c.has_syn(F.lit(None).cast("int"))) is False
