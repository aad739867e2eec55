import importlib
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmarrow.operators import detectors as dt
from flowmarrow.operators import metrics as mt
from flowmarrow.operators import supervised as sv
from flowmarrow.operators import tuning as tn
from flowmarrow.operators.detectors import nets
from flowmarrow.operators.detectors.base import in_blocks
from flowmarrow.operators.detectors.iforest import average_path
from flowmarrow.operators.ensemble import out_of_fold
from flowmarrow.operators.scaling import scaled_array

COLUMNS = [f"f{i}" for i in range(12)]


@pytest.fixture(scope="module")
def data(spark):
    """Normal rows N(0, 0.5), anomalies N(0, 3), as the quality gate."""
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(0, 0.5, (900, 12)), rng.normal(0, 3, (100, 12))])
    rows = [(i, int(i >= 900), "udp_flood" if i % 2 else "syn_flood", *map(float, r)) for i, r in enumerate(x)]
    schema = "conn_id long, y int, attack_type string, " + ", ".join(f"{c} double" for c in COLUMNS)
    made = spark.createDataFrame(rows, schema).repartition(4).cache()
    yield made
    made.unpersist()


def auc(df):
    return mt.roc_auc(df).first()[0]


@pytest.mark.parametrize(
    "make",
    [
        lambda: dt.IsolationForest(n_estimators=50),
        lambda: dt.IsolationForest(n_estimators=20, max_samples=128, max_features=0.5),
        lambda: dt.OneClassSvm(),
        lambda: dt.DenseAutoencoder(encoding_dim=6, epochs=5),
    ],
)
def test_quality_and_persistence(spark, data, tmp_path, make):
    fitted = make().fit(data.filter("y = 0"), COLUMNS)
    scored = fitted.predict(data)
    assert auc(scored) >= 0.95
    m = mt.binary_metrics(scored).first()
    assert m["recall"] > 0.8 and m["false_positive_rate"] < 0.15
    fitted.save(spark, str(tmp_path / "model"))
    again = dt.load_detector(spark, str(tmp_path / "model"))
    assert again.threshold == fitted.threshold
    gap = again.score(fitted.score(data, "a"), "b").agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0]
    assert gap == pytest.approx(0.0, abs=1e-12)


def test_same_forest_for_any_partitioning(data):
    fit = lambda rows: dt.IsolationForest(n_estimators=5).fit(rows.filter("y = 0"), COLUMNS).nodes
    np.testing.assert_allclose(fit(data), fit(data.repartition(3)))


def test_scores_of_a_forest_follow_its_trees(data):
    forest = dt.IsolationForest(n_estimators=7, max_samples=64).fit(data.filter("y = 0"), COLUMNS)
    trees = {t: {int(n[1]): n for n in forest.nodes if n[0] == t} for t in range(7)}

    def depth(tree, x):
        node = tree[0]
        while node[2] >= 0:
            node = tree[int(node[4] if x[int(node[2])] < node[3] else node[5])]
        return node[6]

    rows = forest.score(data.select("*", scaled_array(forest.scaler).alias("x"))).select("x", "score").collect()
    plain = [2.0 ** (-np.mean([depth(t, r["x"]) for t in trees.values()]) / average_path(64)) - forest.offset for r in rows]
    np.testing.assert_allclose([r["score"] for r in rows], plain, atol=1e-12)


def test_scoring_holds_a_few_rows_at_a_time():
    seen = []
    done = in_blocks(lambda m: (seen.append(len(m)), m.sum(axis=1))[1], np.ones((1000, 3)), 256)
    assert seen == [256, 256, 256, 232] and done.shape == (1000,)


def test_rows_of_a_fit_come_in_bounded_tasks(data, monkeypatch):
    sessions = importlib.import_module("flowmarrow.session")
    monkeypatch.setattr(sessions, "TASK_ROWS", 100)
    with sessions.kept_for_fit(data.coalesce(1).select("conn_id")) as kept:
        assert kept.rdd.getNumPartitions() == -(-data.count() // 100) and kept.distinct().count() == data.count()
        assert max(kept.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) <= 110
    monkeypatch.setattr(sessions, "TASK_ROWS", 100_000)
    with sessions.kept_for_fit(data.coalesce(1).select("conn_id")) as kept:
        assert kept.rdd.getNumPartitions() == 1


def test_fits_of_folds_overlap(data):
    met = threading.Barrier(2)

    def member(rows):
        met.wait(60)
        return lambda held: held.withColumn("score", F.col(COLUMNS[0]))

    found = out_of_fold(data.select("conn_id", "y", COLUMNS[0]), "y", "conn_id", {"m": member}, k=2)
    assert found.count() == data.count() and found.filter(~F.col("m").eqNullSafe(F.col(COLUMNS[0]))).isEmpty()


def test_contamination_sets_the_share(data):
    normal = data.filter("y = 0")
    scored = dt.IsolationForest(contamination=0.2, n_estimators=20).fit(normal, COLUMNS).predict(normal)
    assert scored.agg(F.avg("prediction")).first()[0] == pytest.approx(0.2, abs=0.02)


def test_average_path():
    np.testing.assert_allclose(average_path([1, 2, 256]), [0.0, 1.0, 10.2448], atol=1e-3)


def test_lstm_windows(spark, data):
    lstm = dt.LstmAutoencoder(sequence_length=4, units=(8,), latent_dim=4, epochs=2)
    lstm.fit_windows(data.filter("y = 0"), COLUMNS, ["conn_id"])
    windows = lstm.windows(data, ["conn_id"], label="y")
    assert windows.count() == 997
    assert auc(lstm.predict(windows)) >= 0.95
    with pytest.raises(ValueError):
        lstm.score(data)


def test_latent_width(data):
    fitted = dt.DenseAutoencoder(encoding_dim=3, epochs=1).fit(data, COLUMNS)
    assert len(fitted.encode(data).first()["latent"]) == 3
    both = fitted.reconstruct(data).first()
    assert len(both["original"]) == len(both["expected"]) == 12


def test_training_lowers_the_loss(data):
    fitted = dt.DenseAutoencoder(encoding_dim=6, epochs=4).fit(data, COLUMNS)
    assert fitted.history[-1] < fitted.history[0]


@pytest.mark.parametrize(
    "net, shape",
    [
        (nets.dense_net(5, 3, l2=0.0)[0], (4, 5)),
        (nets.lstm_net(4, 3, [4, 3], 2, 0.0)[0], (3, 4, 3)),
        (nets.lstm_net(4, 3, [4, 3], 2, 0.0, bidirectional=True)[0], (3, 4, 3)),
    ],
)
def test_gradients(net, shape):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=shape), net.initial(3) + rng.normal(size=net.size) * 0.1
    g = net.gradient(w, x)
    for i in rng.choice(net.size, 20, replace=False):
        up, down = w.copy(), w.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (net.row_loss(up, x).mean() - net.row_loss(down, x).mean()) / 2e-6
        assert g[i] == pytest.approx(slope, abs=1e-6)


def test_dropout_only_while_training():
    net, _ = nets.dense_net(6, 4, dropout=0.5)
    w, x = net.initial(1), np.ones((8, 6))
    assert np.allclose(net.forward(w, x)[0], net.forward(w, x)[0])
    assert not np.allclose(net.forward(w, x)[0], net.forward(w, x, np.random.default_rng(0))[0])


def test_detector_choice(data):
    forest = dt.IsolationForest(n_estimators=5).fit(data, COLUMNS)
    assert dt.choose_detector({"isolation_forest": forest}, "lstm_ae")[0] == "isolation_forest"
    with pytest.raises(LookupError):
        dt.choose_detector({})
    with pytest.raises(ValueError):
        forest.score(data.drop("f0"))
    with pytest.raises(ValueError):
        dt.OneClassSvm(kernel="cubic")
    both = dt.score_all(data, {"a": forest, "b": forest})
    assert {"score_a", "pred_a", "score_b", "pred_b"} <= set(both.columns)


@pytest.mark.parametrize(
    "kind, settings",
    [("random_forest", {"numTrees": 10, "maxDepth": 5}), ("gradient_boosting", {"maxIter": 5, "maxDepth": 3})],
)
def test_trees_find_the_anomalies(data, kind, settings):
    scored = sv.fit_classifier(data, COLUMNS, kind=kind, **settings).score(data)
    assert auc(scored) >= 0.95
    assert scored.columns == [*data.columns, "score", "prediction"]


def test_logistic_on_a_linear_target(data):
    rows = data.withColumn("y", (F.col("f0") + F.col("f1") > 0.3).cast("int"))
    scored = sv.fit_classifier(rows, COLUMNS, maxIter=50).score(rows)
    assert auc(scored) >= 0.98
    assert sv.with_class_weight(rows).groupBy("y").agg(F.sum("class_weight")).first()[1] == pytest.approx(500.0)


def test_attack_types_and_importance(data):
    rows = data.withColumn("attack_type", F.when(F.col("f3") > 0, "up").otherwise("down"))
    fitted = sv.fit_attack_types(rows, COLUMNS, trees=10, depth=4)
    assert mt.accuracy(fitted.score(rows), "attack_type", "predicted_type").first()[0] > 0.9
    target = rows.withColumn("y", (F.col("f3") > 0).cast("int"))
    forest = sv.fit_classifier(target, COLUMNS, kind="random_forest", numTrees=10, maxDepth=4)
    assert forest.importances().first()["feature"] == "f3"


def test_search(data):
    grid = {"contamination": [0.05, 0.4], "n_estimators": [10]}
    found = tn.summarise(tn.tune_isolation_forest(data, COLUMNS, grid=grid, k=2))
    assert found.count() == 2 and '"contamination": 0.05' in found.first()["params"]
    assert len(tn.candidates(tn.SVM_GRID)) == 100 and len(tn.candidates(tn.LSTM_GRID, 5)) == 5


def test_cross_validation(data):
    folds = tn.cross_validate(data, COLUMNS, k=2, make=lambda: dt.IsolationForest(n_estimators=10))
    summary = {r["metric"]: r for r in mt.cv_summary(folds, ["f1", "roc_auc"]).collect()}
    assert folds.count() == 2 and summary["roc_auc"]["mean"] >= 0.95


def test_nothing_held_out_trains_all_the_same(spark):
    from flowmarrow.operators.detectors.training import averaged_training

    rows = spark.createDataFrame([([float(i % 3)], False) for i in range(60)], "x array<double>, held boolean")

    def step(w, batch, state):
        w += 0.1 * (batch.mean(axis=0) - w)

    loss = lambda w, batch: ((batch - w) ** 2).sum(axis=1)
    weights, history = averaged_training(rows, np.zeros(1), step, loss, 5, batch_size=8)
    assert weights[0] > 0.3 and history == []
    held = rows.withColumn("held", F.lit(True))
    with pytest.raises(ValueError):
        averaged_training(held, np.zeros(1), step, lambda w, b: np.full(len(b), np.nan), 2)


def test_null_cells_count_as_zero(spark, data):
    rows = data.withColumn(COLUMNS[0], F.when(F.col("y") == 0, F.col(COLUMNS[0])))
    fitted = dt.DenseAutoencoder(encoding_dim=2, epochs=1).fit(rows.filter("y = 0 OR y = 1"), COLUMNS)
    assert fitted.predict(rows).filter("score IS NULL OR prediction IS NULL").count() == 0


def test_samples_are_row_counts(data):
    with pytest.raises(ValueError):
        dt.IsolationForest(n_estimators=2, max_samples=0.5).fit(data, COLUMNS)


def test_weights_do_not_depend_on_the_partitioning(spark, data):
    def fitted(parts):
        rows = data.filter("y = 0").repartition(parts)
        lstm = dt.LstmAutoencoder(sequence_length=4, units=(3,), latent_dim=2, epochs=2)
        return [
            dt.DenseAutoencoder(encoding_dim=2, dropout=0.2, epochs=2).fit(rows, COLUMNS).weights,
            dt.OneClassSvm(epochs=2).fit(rows, COLUMNS).weights,
            lstm.fit_windows(rows, COLUMNS, ["conn_id"]).weights,
        ]

    for few, many in zip(fitted(1), fitted(8)):
        assert (few == many).all()


@pytest.mark.parametrize("cut", [1, 7, 1000])
@pytest.mark.parametrize("block", [3, 50])
def test_windows_cut_in_the_task_are_those_of_the_table(spark, cut, block):
    """Rows come in pieces of any length; every window ends once, in its own block and host."""
    import pandas as pd

    from flowmarrow.operators.detectors.training import Windows
    from flowmarrow.operators.features import blocked_rows, sliding_sequences

    rows = spark.createDataFrame([(i, f"h{i * i % 5}", float(i)) for i in range(160)], "id long, host string, v double")
    got = blocked_rows(rows, ["v"], ["id"], 4, "host", block=block).orderBy("_block", "_ord").toPandas()
    frame = pd.DataFrame({"x": got["cells"], "run": got["_block"].astype(str) + got["host"], "own": got["_block"] == got["_own"], "held": got["id"] % 3 == 0})
    maker, windows, held = Windows(4), [], []
    for k in range(0, len(frame), cut):
        x, h = maker.feed(frame.iloc[k : k + cut])
        windows += x.tolist()
        held += h.tolist()
    want = [([c[0] for c in r.sequence], r.id % 3 == 0) for r in sliding_sequences(rows, ["v"], ["id"], 4, "host").collect()]
    assert sorted(zip(windows, held)) == sorted(want)


def test_the_search_uses_the_scorer_it_is_given(data):
    seen = []

    def scorer(df, y):
        seen.append(y)
        return mt.binary_metrics(df, y).withColumn("f1", F.lit(0.25))

    found = tn.search(data, COLUMNS, dt.IsolationForest, {"n_estimators": [5], "contamination": [0.1, 0.2]}, k=2, scorer=scorer)
    assert {r["f1"] for r in found.collect()} == {0.25} and len(seen) == 4
