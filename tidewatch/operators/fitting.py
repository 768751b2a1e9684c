"""Parameters from data: scaling of states, benign reconstruction error, measures of verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import mean_squared_error, signed_log1p
from tidewatch.operators.scorers import Scorer
from tidewatch.operators.sequences import scaled_table, sequences
from tidewatch.plans.materialize import written
from tidewatch.sources.bundle import Bundle


def fit_scaler(states: DataFrame) -> DataFrame:
    """Per dimension of the state vectors: ``dim``, ``mean`` and ``scale`` after the signed log.

    The scale is the population standard deviation; a dimension that never varies gets 1, as
    a scale of 0 cannot standardise. A task sends one row per dimension, whatever it reads.
    """
    long = states.select(F.posexplode("state").alias("dim", "value"))
    logged = signed_log1p(F.col("value"))
    constant = F.min("value") == F.max("value")
    return long.groupBy("dim").agg(
        F.avg(logged).alias("mean"),
        F.when(constant, 1.0).otherwise(F.stddev_pop(logged)).alias("scale"),
    )


def reconstruction_errors(seqs: DataFrame, bundle: Bundle, scorer: Scorer) -> DataFrame:
    """Unrounded error of the predicted next state of each sequence, as ``mse``."""
    predicted = seqs.withColumn("_out", scorer(F.col("seq"), bundle.k_steps))
    kept = [c for c in seqs.columns if c not in ("state", "scaled", "seq")]
    return predicted.select(
        *kept, mean_squared_error(F.col("_out.pred_state"), F.col("scaled")).alias("mse")
    )


def fit_benign_baseline(errors: DataFrame, benign: Column) -> DataFrame:
    """One row: ``mean`` and population ``std`` of the error over benign windows, and their
    number. A null ``benign`` is not benign; without benign windows mean and std are null."""
    return errors.filter(benign).agg(
        F.avg("mse").alias("mean"),
        F.stddev_pop("mse").alias("std"),
        F.count(F.lit(1)).alias("windows"),
    )


def eval_binary(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row of counts and measures of a yes-or-no verdict against labels.

    Rows without a verdict or label count nowhere; a measure with nothing below the line is
    null.
    """

    def both(p: bool, a: bool) -> Column:
        return F.count(F.when((predicted == F.lit(p)) & (actual == F.lit(a)), 1))

    counts = rows.agg(
        both(True, True).alias("tp"),
        both(True, False).alias("fp"),
        both(False, True).alias("fn"),
        both(False, False).alias("tn"),
    )

    def share(of: str, whole: Sequence[str]) -> Column:
        return F.try_divide(F.col(of), sum((F.col(c) for c in whole), F.lit(0)))

    return counts.select(
        "tp",
        "fp",
        "fn",
        "tn",
        share("tp", ("tp", "fp")).alias("precision"),
        share("tp", ("tp", "fn")).alias("recall"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        share("fp", ("fp", "tn")).alias("false_positive_rate"),
    )


def fitted_bundle(
    states: DataFrame, labels: DataFrame, keys: Sequence[str], bundle: Bundle, scorer: Scorer
) -> Bundle:
    """``bundle`` with scaling fitted on all ``states`` and a baseline fitted on benign windows.

    ``labels`` has the keys, ``window_start`` and a boolean ``attack``; a window without a
    label is left out of the baseline. The driver gets one row per dimension and one more.
    """
    table = written(states, "states")
    rows = sorted(fit_scaler(table).collect(), key=lambda r: r["dim"])
    scaled = replace(
        bundle,
        scaler_mean=[r["mean"] for r in rows],
        scaler_scale=[r["scale"] for r in rows],
        baseline=None,
    )
    ready = scaled_table(table, scaled.scaler_mean, scaled.scaler_scale)
    seqs = sequences(ready, bundle.seq_len, bundle.window_size, keys=keys)
    errors = reconstruction_errors(seqs, scaled, scorer).join(labels, [*keys, "window_start"])
    found = fit_benign_baseline(errors, ~F.col("attack")).first()
    if not found["windows"]:
        return scaled
    return replace(scaled, baseline={"mean": found["mean"], "std": found["std"]})
