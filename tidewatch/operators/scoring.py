"""Scored windows: hybrid risk, tactic, forecast and attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.names import dimension_name, horizon_labels, tactic_name
from tidewatch.functions.numeric import (
    first_argmax,
    max_keep_first,
    mean_squared_error,
    sigmoid,
)
from tidewatch.functions.report import gate_class
from tidewatch.functions.timeparse import window_label
from tidewatch.operators.scorers import Scorer
from tidewatch.sources.bundle import Bundle

TOP_FEATURES = 3


def calibrated_error(mse: Column, baseline: dict) -> Column:
    """Reconstruction error as a probability: half at three deviations above benign."""
    z = (mse - F.lit(float(baseline["mean"]))) / F.lit(float(baseline["std"]) + 1e-8)
    return sigmoid(z - 3.0)


def top_features(importance: Column, names: Sequence[str], k: int = TOP_FEATURES) -> Column:
    """The k most important dimensions, relative to the largest; ties by lower index."""
    largest = F.array_max(importance).cast("double")
    whole = F.when(largest > 0, largest).otherwise(1.0)
    ranked = F.array_sort(
        F.transform(importance, lambda v, i: F.struct((-v.cast("double")).alias("v"), i.alias("i")))
    )
    return F.transform(
        F.slice(ranked, 1, k),
        lambda x: F.struct(
            dimension_name(names, x["i"]).alias("feature"),
            F.round(-x["v"] / whole, 4).alias("importance"),
        ),
    )


def trajectory(steps: Column, bundle: Bundle) -> Column:
    """Forecast points; the class is gated on the step's own attack probability."""
    labels = F.array(
        *[F.lit(t) for t in horizon_labels(bundle.k_steps, bundle.window_size)]
    )

    def point(step: Column, i: Column) -> Column:
        prob = sigmoid(step["logit"].cast("double"))
        cls = gate_class(first_argmax(step["class_logits"]), prob, bundle.threshold)
        return F.struct(
            F.get(labels, i).alias("step_ahead"),
            F.round(prob, 4).alias("prob"),
            tactic_name(cls).alias("stage"),
        )

    return F.transform(steps, point)


def score_sequences(seqs: DataFrame, bundle: Bundle, scorer: Scorer) -> DataFrame:
    """Scored windows of ``sequences`` output (with ``scaled`` as the true next state).

    The current class is gated on the unrounded hybrid risk. Without a benign baseline the
    risk is the attack probability alone.
    """
    keys = [c for c in seqs.columns if c not in _WORKING]
    run = seqs.withColumn("_out", scorer(F.col("seq"), bundle.k_steps))
    own = F.get("_out.steps", F.lit(0))
    parts = run.withColumns(
        {
            "_prob": sigmoid(own["logit"].cast("double")),
            "_class": first_argmax(own["class_logits"]),
        }
    )
    null = F.lit(None).cast("double")
    if bundle.baseline is None:
        parts = parts.withColumns({"_mse": null, "_cal": null, "_risk": F.col("_prob")})
    else:
        parts = parts.withColumn(
            "_mse", mean_squared_error(F.col("_out.pred_state"), F.col("scaled"))
        )
        parts = parts.withColumn("_cal", calibrated_error(F.col("_mse"), bundle.baseline))
        parts = parts.withColumn("_risk", max_keep_first(F.col("_prob"), F.col("_cal")))
    base = bundle.baseline or {}
    stage = tactic_name(gate_class(F.col("_class"), F.col("_risk"), bundle.threshold))
    return parts.select(
        *keys,
        "step_index",
        "window_start",
        window_label(F.col("window_start")).alias("timestamp"),
        "flow_count",
        F.round("_risk", 4).alias("current_risk"),
        stage.alias("current_stage"),
        trajectory(F.col("_out.steps"), bundle).alias("trajectory"),
        top_features(F.col("_out.importance"), bundle.names).alias("shap_features"),
        F.struct(
            F.round("_prob", 4).alias("attack_head_prob"),
            F.round("_cal", 4).alias("calibrated_mse"),
            F.round("_mse", 6).alias("raw_mse"),
            F.when(
                F.lit(bundle.baseline is not None),
                F.struct(
                    F.lit(base.get("mean")).cast("double").alias("mean"),
                    F.lit(base.get("std")).cast("double").alias("std"),
                ),
            ).alias("benign_mse_baseline"),
        ).alias("_debug"),
    )


_WORKING = ("step_index", "window_start", "flow_count", "state", "scaled", "seq")
