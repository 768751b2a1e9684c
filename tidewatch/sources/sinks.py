"""Writers: rotated event text, flow archives, column subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.rotation import slot_date, slot_key
from tidewatch.schemas import EVENT_ROTATION_MINUTES, FLOW_ROTATION_MINUTES


def write_events(
    events: DataFrame,
    folder: str,
    rotation_minutes: int = EVENT_ROTATION_MINUTES,
    at: Column | None = None,
) -> None:
    """Append events' ``json`` as text lines below ``date=.../slot=...``.

    The slot is that of the write (``at``, default now in UTC), not of the events. An empty
    table writes no file.
    """
    now = F.current_timestamp() if at is None else at
    lines = events.select(
        F.col("json").alias("value"),
        slot_date(now).alias("date"),
        slot_key(now, rotation_minutes).alias("slot"),
    )
    lines.write.mode("append").partitionBy("date", "slot").text(folder)


def select_fields(df: DataFrame, fields: str | Sequence[str] | None = None) -> DataFrame:
    """Only the named columns ('a,b,c' or a list); all of them by default."""
    if not fields:
        return df
    names = fields.split(",") if isinstance(fields, str) else list(fields)
    return df.select(*[F.col(f"`{n.strip()}`") for n in names])


def write_flow_archive(
    flows: DataFrame,
    folder: str,
    fields: str | Sequence[str] | None = None,
    rotation_minutes: int = FLOW_ROTATION_MINUTES,
    at: Column | None = None,
) -> None:
    """Append flows as CSV with header below ``date=.../slot=...`` of the write."""
    now = F.current_timestamp() if at is None else at
    chosen = select_fields(flows, fields)
    chosen.withColumn("date", slot_date(now)).withColumn(
        "slot", slot_key(now, rotation_minutes)
    ).write.mode("append").partitionBy("date", "slot").csv(folder, header=True)


def write_captures(
    flows: DataFrame, folder: str, fields: str | Sequence[str] | None = None, merge: bool = False
) -> None:
    """Flows of many captures as CSV: one output below ``capture_id=`` each, or one for all."""
    chosen = select_fields(flows.drop("capture_id"), fields).columns
    kept = flows.select("capture_id", *[F.col(f"`{c}`") for c in chosen])
    if merge:
        kept.drop("capture_id").write.csv(folder, header=True)
    else:
        kept.hint("rebalance", "capture_id").write.partitionBy("capture_id").csv(
            folder, header=True
        )


def store_capture_rows(rows: DataFrame, folder: str) -> None:
    """Captures of unlike headers (capture_id, flow), in one pass: one output below each
    ``capture_id=``, with the columns of that capture."""
    rows.hint("rebalance", "capture_id").write.partitionBy("capture_id").parquet(folder)
