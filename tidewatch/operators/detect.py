"""Detection jobs: flow records in, scored windows, log and summary out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.report import flag_status, percent_text, risk_band
from tidewatch.operators.flows import FlowInputError, align_flows
from tidewatch.operators.scorers import Scorer
from tidewatch.operators.scoring import score_sequences
from tidewatch.operators.sequences import (
    TooFewWindowsError,
    capture_lengths,
    scaled_table,
    sequences,
)
from tidewatch.operators.states import window_states
from tidewatch.plans.materialize import written
from tidewatch.schemas import VERDICT_ATTACK, VERDICT_CLEAR
from tidewatch.sources.bundle import Bundle

CAPTURE = "capture_id"


def detection_log(windows: DataFrame, threshold: float) -> DataFrame:
    """Per window: time, hybrid risk, and whether the rounded risk reaches the threshold."""
    return windows.select(
        CAPTURE,
        "step_index",
        "timestamp",
        F.col("current_risk").alias("attack_prob"),
        (F.col("current_risk") >= threshold).alias("is_attack"),
    )


def _attacks(threshold: float) -> Column:
    return F.count(F.when(F.col("current_risk") >= threshold, 1))


def detection_summary(windows: DataFrame, threshold: float) -> DataFrame:
    """Per capture: windows, anomalous windows, verdict."""
    found = F.col("anomalous_windows_detected")
    return (
        windows.groupBy(CAPTURE)
        .agg(
            F.count(F.lit(1)).alias("total_windows_evaluated"),
            _attacks(threshold).alias("anomalous_windows_detected"),
        )
        .withColumn("model_threshold", F.lit(float(threshold)))
        .withColumn("verdict", F.when(found > 0, VERDICT_ATTACK).otherwise(VERDICT_CLEAR))
    )


def scenario_metadata(
    windows: DataFrame, flows: DataFrame, threshold: float, first_columns: Sequence[str]
) -> DataFrame:
    """Per capture: what the scenario store keeps besides the windows.

    ``rows_ingested`` counts the flows as read, before rows without a time are dropped.
    """
    ingested = flows.groupBy(CAPTURE).agg(F.count(F.lit(1)).alias("rows_ingested"))
    scored = windows.groupBy(CAPTURE).agg(
        F.count(F.lit(1)).alias("total_windows"),
        _attacks(threshold).alias("attack_windows_detected"),
    )
    label = F.col(CAPTURE).cast("string")
    return scored.join(ingested, CAPTURE).select(
        CAPTURE,
        F.concat(F.lit("Ingested Dataset: "), label).alias("name"),
        F.concat(F.lit("Uploaded capture ("), label, F.lit(")")).alias("target_asset"),
        "total_windows",
        F.array(*[F.lit(c) for c in first_columns]).alias("detected_features"),
        "rows_ingested",
        "attack_windows_detected",
    )


@dataclass(frozen=True)
class Detection:
    windows: DataFrame
    log: DataFrame
    summary: DataFrame
    metadata: DataFrame


def scored_windows(
    flows: DataFrame, bundle: Bundle, scorer: Scorer, strict: bool = False, **cleaning
) -> DataFrame:
    """Scored windows of every capture that is long enough.

    ``strict`` raises if the table is empty or any capture is too short, as for a single
    upload. The states are written once, between the pass over the flows and the passes
    over the far fewer windows.
    """
    if strict and flows.isEmpty():
        raise FlowInputError("the flow table has no rows")
    cleaned = align_flows(flows, bundle.feature_cols, **cleaning)
    states = window_states(cleaned, bundle.feature_cols, bundle.spark_window)
    table = scaled_table(states, bundle.scaler_mean, bundle.scaler_scale)
    if strict:
        lengths = capture_lengths(table, bundle.seq_len)
        short = lengths.filter(~F.col("enough")).orderBy("windows").first()
        if short or lengths.isEmpty():
            have = short["windows"] if short else 0
            raise TooFewWindowsError(
                f"need at least {bundle.seq_len + 1} traffic windows, got {have}"
            )
    seqs = sequences(table, bundle.seq_len, bundle.window_size)
    return score_sequences(seqs, bundle, scorer)


def detect(
    flows: DataFrame, bundle: Bundle, scorer: Scorer, strict: bool = False, **cleaning
) -> Detection:
    """The whole job on flows with a ``capture_id``."""
    windows = written(
        scored_windows(flows, bundle, scorer, strict, **cleaning), "scored-windows"
    )
    header = [c for c in flows.columns if c != CAPTURE][:8]
    return Detection(
        windows,
        detection_log(windows, bundle.threshold),
        detection_summary(windows, bundle.threshold),
        scenario_metadata(windows, flows, bundle.threshold, header),
    )


def forecast_points(windows: DataFrame) -> DataFrame:
    """Observed risk and forecast of each window as rows: ``point`` 0 is the observation."""
    start = F.array(
        F.struct(
            F.lit("T_0 (Observed)").alias("step_ahead"),
            F.coalesce("current_risk", F.lit(0.0)).alias("prob"),
            F.col("current_stage").alias("stage"),
        )
    )
    return windows.select(
        CAPTURE, "step_index", F.posexplode(F.concat(start, "trajectory")).alias("point", "_p")
    ).select(
        CAPTURE,
        "step_index",
        "point",
        F.col("_p.step_ahead").alias("time_key"),
        F.coalesce("_p.prob", F.lit(0.0)).alias("probability"),
        F.col("_p.stage").alias("stage"),
    )


def dashboard_rows(windows: DataFrame, threshold: float) -> DataFrame:
    """Risk band, flag and percent text of each window."""
    risk = F.coalesce("current_risk", F.lit(0.0))
    return windows.select(
        CAPTURE,
        "step_index",
        risk.alias("current_risk"),
        risk_band(F.col("current_risk")).alias("band"),
        flag_status(risk >= threshold).alias("status"),
        percent_text(risk).alias("percent"),
    )
