"""Queries do the job that they name: the settings, folds and searches of the operators, on small tables of their own."""

import datetime as dt

import pytest

from flowmarrow.operators import supervised as sv
from flowmarrow.operators import tuning as tn
from flowmarrow.operators.detectors import IsolationForest
from flowmarrow.plans import model_queries as mq


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    start, kinds = dt.datetime(2024, 1, 1), ["error", "view", "click", "view", "signup"]
    rows = [(i, start + dt.timedelta(hours=i), i * 7 % 50, kinds[i * i % 5], float(i * 37 % 101), f'{{"k": {i % 30}}}') for i in range(300)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_cross_day_fits_with_full_settings(spark, tables, monkeypatch):
    fits, real = {}, sv.fit_classifier

    def fit(df, columns, y="y", kind="logistic", **settings):
        fits[kind] = sv.SETTINGS[kind] | settings
        return real(df, columns, y, "logistic", maxIter=1)

    monkeypatch.setattr(sv, "fit_classifier", fit)
    assert mq.cross_day(spark, tables).count() == 3
    assert fits["logistic"]["maxIter"] == 2000
    assert (fits["random_forest"]["numTrees"], fits["random_forest"]["maxDepth"]) == (300, 30)
    assert (fits["gradient_boosting"]["maxIter"], fits["gradient_boosting"]["maxDepth"]) == (100, 7)


def test_cross_validation_has_five_folds_of_whole_forests(spark, tables, monkeypatch):
    fits, real = [], IsolationForest.fit

    def fit(self, *args, **options):
        fits.append(self._params())
        return real(self, *args, **options)

    monkeypatch.setattr(IsolationForest, "fit", fit)
    assert sorted(r["fold"] for r in mq.cross_validation(spark, tables).collect()) == [0, 1, 2, 3, 4]
    assert fits == [IsolationForest()._params()] * 5 and fits[0]["n_estimators"] == 100


def test_tuning_draws_twenty_of_the_whole_grids_on_five_folds(spark, tables, monkeypatch):
    seen, real = {}, tn.search

    def search(df, columns, make, grid, row_id, y, n_iter, k, **options):
        drawn = tn.candidates(grid, n_iter)
        seen[make.__name__] = (grid, len(drawn), k)
        return real(df, columns, make, {name: [value] for name, value in drawn[0].items()}, row_id, y, None, 2)

    monkeypatch.setattr(tn, "search", search)
    assert mq.tune_then_test(spark, tables).count() == 2
    assert seen == {"IsolationForest": (tn.IFOREST_GRID, 20, 5), "OneClassSvm": (tn.SVM_GRID, 20, 5)}
    assert len(tn.candidates(tn.IFOREST_GRID)) == 108 and len(tn.candidates(tn.SVM_GRID)) == 100
