"""Fitting of scalers and baselines, and the measures of verdicts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.fitting import eval_binary, fit_benign_baseline, fit_scaler


def test_scaler_matches_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(0, 50, (40, 3)), 3)
    values[:, 2] = 7.5
    rows = [(v.tolist(),) for v in values]
    fitted = fit_scaler(spark.createDataFrame(rows, "state array<double>")).orderBy("dim").collect()
    logged = np.sign(values) * np.log1p(np.abs(values))
    assert [r["mean"] for r in fitted] == pytest.approx(logged.mean(0).tolist())
    assert [r["scale"] for r in fitted] == pytest.approx([*logged.std(0)[:2], 1.0])


def test_baseline_takes_benign_windows_only(spark):
    rows = [(1.0, True), (3.0, True), (50.0, False), (90.0, None)]
    errors = spark.createDataFrame(rows, "mse double, benign boolean")
    got = fit_benign_baseline(errors, F.col("benign")).first()
    assert (got["mean"], got["std"], got["windows"]) == (2.0, 1.0, 2)
    none = fit_benign_baseline(errors.filter("mse > 60"), F.col("benign")).first()
    assert (none["mean"], none["std"], none["windows"]) == (None, None, 0)


def test_measures(spark):
    rows = [(True, True)] * 3 + [(True, False)] * 2 + [(False, True)] + [(False, False)] * 4
    df = spark.createDataFrame([*rows, (None, True), (True, None)], "p boolean, a boolean")
    got = eval_binary(df, F.col("p"), F.col("a")).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (3, 2, 1, 4)
    assert got["precision"] == pytest.approx(3 / 5)
    assert got["recall"] == pytest.approx(3 / 4)
    assert got["f1"] == pytest.approx(6 / 9)
    assert got["false_positive_rate"] == pytest.approx(2 / 6)
    empty = eval_binary(df.limit(0), F.col("p"), F.col("a")).first()
    assert (empty["tp"], empty["f1"], empty["precision"]) == (0, None, None)
