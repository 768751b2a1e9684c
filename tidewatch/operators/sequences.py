"""Sliding sequences of consecutive state vectors and their scaling."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import as_float32, double_array, scale_state
from tidewatch.plans.materialize import written
from tidewatch.plans.ordered import with_previous, with_row_number

# Windows of one capture that one task handles at most.
CHUNK_ROWS = 4096


def scaled_states(states: DataFrame, mean: Sequence[float], scale: Sequence[float]) -> DataFrame:
    """Add ``scaled``: signed log, standardised, clipped; computed once per window."""
    if any(s == 0 for s in scale):
        raise ValueError("a scale of 0 cannot standardise")
    return states.withColumn(
        "scaled", scale_state(F.col("state"), double_array(mean), double_array(scale))
    )


def sequences(
    states: DataFrame,
    seq_len: int,
    window_size: str = "1 minute",
    value: str = "scaled",
    keys: Sequence[str] = ("capture_id",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per window that has ``seq_len`` windows before it.

    Neighbours are rows, so a gap in time is bridged. The row itself is the target: its
    ``value`` is the true next state of ``seq`` (an array of float32 vectors). Columns:
    keys, ``step_index`` from 0, those of ``states``, ``seq``. ``states`` should be a
    written table.
    """
    micros = int(pd.Timedelta(window_size).total_seconds() * 1e6) * chunk_rows
    bucket = F.floor(F.unix_micros("window_start") / micros)
    numbered = with_row_number(states, keys, "window_start", bucket)
    rows = numbered.withColumn("_input", as_float32(F.col(value)))
    framed = with_previous(rows, keys, "_row", "_input", seq_len, max(chunk_rows, seq_len))
    return framed.select(
        *keys,
        (F.col("_row") - seq_len).alias("step_index"),
        *[c for c in states.columns if c not in keys],
        F.col("_previous").alias("seq"),
    )


def capture_lengths(
    states: DataFrame, seq_len: int, keys: Sequence[str] = ("capture_id",)
) -> DataFrame:
    """Windows per capture and whether they suffice for at least one sequence."""
    counts = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"))
    return counts.withColumn("enough", F.col("windows") >= seq_len + 1)


class TooFewWindowsError(ValueError):
    """The capture is too short for one sequence."""


def scaled_table(
    states: DataFrame, mean: Sequence[float], scale: Sequence[float]
) -> DataFrame:
    """Scaled states as a written table, ready for :func:`sequences`."""
    return written(scaled_states(states, mean, scale), "scaled-states")
