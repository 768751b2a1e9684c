"""Window states of a stream of flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.flows import TIME_COLUMN
from tidewatch.operators.states import (
    block_statistics,
    exploded_blocks,
    packed_state,
    state_column,
)


def stream_window_states(
    flows: DataFrame,
    feature_cols: Sequence[str],
    window_size: str = "1 minute",
    delay: str = "1 minute",
    keys: Sequence[str] = ("capture_id",),
    std_mode: str = "population",
) -> DataFrame:
    """Streaming form of ``window_states``, for append mode.

    A window is emitted once the watermark passes its end; flows later than ``delay`` are
    lost, whereas the rolling buffer keeps late flows until a newer one arrives. Two chained
    aggregations, as in batch: neither keeps a whole window in one state row.
    """
    marked = flows.withWatermark(TIME_COLUMN, delay)
    window = F.window(F.col(TIME_COLUMN), window_size).alias("window")
    cells = exploded_blocks(marked, feature_cols, [*[F.col(k) for k in keys], window])
    parts = cells.groupBy(*keys, "window", "_block", "_item").agg(*block_statistics(std_mode))
    packed = parts.groupBy(*keys, "window").agg(*packed_state(std_mode))
    return packed.select(
        *keys,
        F.col("window.start").alias("window_start"),
        "flow_count",
        state_column(feature_cols).alias("state"),
    )
