import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmarrow.operators import ordered as o
from flowmarrow.operators.features import sliding_sequences


def hot_values(n=3001):
    rng = np.random.default_rng(3)
    x = np.round(rng.gamma(2.0, 1.0, n), 2)
    x[: n // 3] = 1.25  # one value holds a third of the rows
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, float(v), i % 3) for i, v in enumerate(x)], "id long, v double, k int")


@pytest.mark.parametrize("shares", [[0.5], [0.0, 0.3, 0.95, 1.0], list(np.linspace(0, 1, 1000))])
def test_percentiles_match_numpy(spark, many_ranges, shares):
    x = hot_values()
    got = o.percentile_values(frame(spark, x), "v", shares)
    np.testing.assert_allclose(got, np.percentile(x, np.array(shares) * 100), atol=1e-9)


def test_percentiles_of_a_small_table(spark):
    x = hot_values(500)
    got = o.percentile_values(frame(spark, x), "v", [0.1, 0.99])
    np.testing.assert_allclose(got, np.percentile(x, [10, 99]), atol=1e-9)


def test_percentile_of_four_numbers(spark):
    assert o.percentile_values(frame(spark, [1, 2, 3, 4]), "v", [0.99]) == pytest.approx([3.97])


def test_percentiles_of_nothing(spark):
    assert o.percentile_values(frame(spark, []).filter("id < 0"), "v", [0.5]) == []


def test_prefix_sums_over_ties(spark, many_ranges):
    x = hot_values()
    table = o.value_table(frame(spark, x), "v", {"k": F.col("k")})
    got = {r["v"]: (r["cum_k"], r["all_k"]) for r in o.prefix_sums(table, "v", ["k"]).collect()}
    k = np.arange(len(x)) % 3
    for v in np.unique(x):
        assert got[v] == (k[x <= v].sum(), k.sum())


@pytest.mark.parametrize("broadcast_rows", [100_000, 10])
def test_group_stats_with_hot_and_null_keys(spark, broadcast_rows):
    n = 3000
    key = lambda i: "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i}"
    df = spark.createDataFrame([(i, key(i)) for i in range(n)], "id long, k string")
    stats = df.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    got = o.with_group_stats(df, stats, ["k"], "n", ["id"], broadcast_rows).collect()
    assert len(got) == n
    for r in got:
        want = None if r["k"] is None else 1000 if r["k"] == "hot" else 1
        assert r["n"] == want


def test_hot_key_is_split(spark):
    df = spark.range(2000).select("id", F.lit("hot").alias("k"))
    counts = df.groupBy("k").agg(F.count("*").alias("n"))
    left, right = o.salted_pair(df, counts, counts, ["k"], "n", ["id"])
    assert left.select("_salt").distinct().count() > 100
    assert right.count() == o.HOT_SHARE


def test_ordinal_is_the_global_position(spark):
    x = hot_values()
    got = o.with_ordinal(frame(spark, x).repartition(7), ["v", "id"]).collect()
    assert len(got) == len(x)
    for position, r in enumerate(sorted(got, key=lambda r: (r["v"], r["id"]))):
        assert r["ordinal"] == position


@pytest.mark.parametrize("newest", [False, True])
def test_first_rows_narrow_down(spark, monkeypatch, newest):
    monkeypatch.setattr(o, "NARROW_ABOVE", 2)
    df = spark.range(5000).withColumn("v", F.col("id") % 977)
    got = [(r["v"], r["id"]) for r in o.first_rows(df, ["v", "id"], 20, newest).collect()]
    assert got == sorted(((i % 977, i) for i in range(5000)), reverse=newest)[:20]


@pytest.mark.parametrize("host", [None, "h"])
def test_sequences_across_blocks(spark, host):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.integers(0, 50)), "abc"[int(rng.integers(0, 3))], float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, t long, h string, x double")
    got = sliding_sequences(df, ["x"], ["t", "id"], 4, host=host, block=7)
    want = set()
    for group in "abc" if host else [None]:
        part = sorted((r for r in rows if group in (None, r[2])), key=lambda r: (r[1], r[0]))
        for i in range(3, len(part)):
            want.add((part[i][0], tuple(r[3] for r in part[i - 3 : i + 1])))
    assert {(r["id"], tuple(c[0] for c in r["sequence"])) for r in got.collect()} == want


def test_prefix_sums_in_groups_over_two_levels(spark, many_ranges):
    rng = np.random.default_rng(8)
    rows = [(None if i % 5 == 0 else "hot" if i % 5 < 3 else f"g{i % 30}", float(v)) for i, v in enumerate(rng.permutation(2000))]
    table = spark.createDataFrame([(g, v, 1, int(v) % 7) for g, v in rows], "g string, v double, n long, w long")
    got = {(r.g, r.v): (r.cum_n, r.all_n, r.cum_w, r.all_w) for r in o.prefix_sums(table, "v", ["n", "w"], ["g"]).collect()}
    assert len(got) == 2000
    for group in {g for g, _ in rows}:
        mine = sorted(v for g, v in rows if g == group)
        weights = np.cumsum([int(v) % 7 for v in mine])
        assert [got[group, v] for v in mine] == [(i + 1, len(mine), weights[i], weights[-1]) for i in range(len(mine))]


@pytest.mark.parametrize("share", [0.0, 0.37, 0.5, 0.95, 0.9995, 1.0])
def test_a_narrowed_percentile_matches_numpy(spark, monkeypatch, share):
    monkeypatch.setattr(o, "SKETCH", 50)  # a coarse sketch, so that brackets miss and are widened
    x = hot_values(4001)
    assert o.percentile_value(frame(spark, x), "v", share, rows=20) == pytest.approx(np.percentile(x, share * 100), abs=1e-9)


def test_narrowed_percentiles_of_odd_columns(spark):
    assert o.percentile_value(frame(spark, [1.0]).filter("id < 0"), "v", 0.5) is None
    assert o.percentile_value(frame(spark, [2.5] * 300), "v", 0.3, rows=10) == 2.5
    some = spark.createDataFrame([(None,), (4.0,), (None,), (2.0,)], "v double")
    assert o.percentile_value(some, "v", 0.5) == 3.0
