"""Rolling buffer of recent flows, ordered by event time.

A buffer row is ``arrival_seq, sensor, ts_epoch, _id, payload``. Inserting a flow removes
whatever is more than the retention time older than *that* flow, so a row survives exactly
if no flow arriving at or after it is that much newer.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.timeparse import buffer_epoch, millisecond_text
from tidewatch.plans import files
from tidewatch.plans.materialize import broadcast_if_small, computed_once, written
from tidewatch.plans.ordered import (
    CHUNK_BITS,
    SUMMARY_ROWS,
    next_above,
    with_later_max,
    with_row_number,
    with_running_sum,
)
from tidewatch.schemas import BUFFER_KEY, BUFFER_RETENTION_SECONDS

BUFFER_SCHEMA = "arrival_seq bigint, sensor string, ts_epoch double, _id string, payload string"
SENSOR = "sensor"
# A column of this name gives flows their arrival order and is no part of them.
ARRIVAL = "_pos"


def _row_id(seq: Column, sensor: Column) -> Column:
    """Unique id of a flow without one. Made from its arrival position, not at random, so a
    task that runs again produces the same id."""
    digest = F.md5(F.concat_ws(":", sensor, seq.cast("string")))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, n) for start, n in cuts])


def buffer_rows(
    flows: DataFrame,
    seq: Column | None = None,
    sensor: Column | None = None,
    timestamp: Column | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Flows as buffer rows. ``timestamp`` (epoch seconds) overrides the flow's own time.

    ``seq`` is the arrival order, unique per sensor; the column ``_pos``, if there is one, or
    the scan order of these flows by default
    (for a table that grows by batches see :func:`append_flows`). A flow's own
    ``_id`` is kept. Flows whose time is NaN cannot be ordered and are left out.
    """
    columns = [c for c in flows.columns if c not in ("_id", ARRIVAL)]
    # One moment for all rows and all reads of them.
    now = F.lit(datetime.now(UTC)) if now is None else now
    if seq is None:
        seq = F.col(ARRIVAL) if ARRIVAL in flows.columns else F.monotonically_increasing_id()
    sensor = F.lit(BUFFER_KEY) if sensor is None else sensor
    if timestamp is None and "timestamp" in flows.columns:
        numeric = isinstance(flows.schema["timestamp"].dataType, T.NumericType)
        timestamp = buffer_epoch(F.col("timestamp"), numeric, now)
    elif timestamp is None:
        timestamp = buffer_epoch(F.lit(None).cast("string"), False, now)
    staged = flows.withColumns({"_seq": seq, "_sensor": sensor})
    staged = computed_once(staged, "_epoch", timestamp.cast("double")).filter(~F.isnan("_epoch"))
    made = _row_id(F.col("_seq"), F.col("_sensor"))
    own = F.coalesce(F.col("_id").cast("string"), made) if "_id" in flows.columns else made
    staged = staged.withColumn("_id", own)
    # Absent values are absent keys of the flow.
    payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns], F.col("_id")))
    return staged.select(
        F.col("_seq").alias("arrival_seq"),
        F.col("_sensor").alias(SENSOR),
        F.col("_epoch").alias("ts_epoch"),
        "_id",
        payload.alias("payload"),
    )


def survivors(
    rows: DataFrame,
    retention: float = BUFFER_RETENTION_SECONDS,
    supplied_ids: bool = False,
    bits: tuple[int, ...] = CHUNK_BITS,
    limit: int = SUMMARY_ROWS,
    tops: DataFrame | None = None,
) -> DataFrame:
    """Rows still buffered after all inserts, in arrival order.

    ``supplied_ids``: flows bring their own ``_id``, so the same text can be inserted again
    and then only its last insert counts. ``tops``: see :func:`with_later_max`.
    """
    kept = with_later_max(rows, [SENSOR], "arrival_seq", "ts_epoch", retention, bits, limit, tops)
    kept = kept.drop("_reach")
    if not supplied_ids:
        return kept
    member = [SENSOR, "payload"]
    kept = written(kept, "survivors")
    held = broadcast_if_small(kept).select(*member)
    again = rows.select(*member, "arrival_seq").join(held, member, "left_semi")
    last = again.groupBy(*member).agg(F.max("arrival_seq").alias("arrival_seq"))
    return kept.join(last, [*member, "arrival_seq"], "left_semi")


def sizes_after_inserts(
    rows: DataFrame, retention: float = BUFFER_RETENTION_SECONDS, **how
) -> DataFrame:
    """Every insert (sensor, arrival_seq, _id, ts_epoch) with ``flow_count``, the number of
    flows the sensor's buffer holds after it.

    A flow leaves with the first later arrival that is newer by more than the retention time.
    Every insert counts as a flow of its own. ``how`` goes to :func:`next_above`.
    """
    names = [SENSOR, "arrival_seq", "_id", "ts_epoch"]
    rows = written(rows.select(*names), "inserts")
    bucket = F.shiftright("arrival_seq", CHUNK_BITS[0])
    placed = written(with_row_number(rows, [SENSOR], "arrival_seq", bucket), "placed-inserts")
    reach = placed.withColumn("_reach", F.col("ts_epoch") - F.lit(float(retention)))
    gone = next_above(reach, [SENSOR], "_row", "_reach", "ts_epoch", **how)
    # Many flows may leave with one insert.
    leaves = gone.filter("_next is not null").groupBy(SENSOR, F.col("_next").alias("_row")).agg(
        F.count(F.lit(1)).alias("_left")
    )
    steps = placed.join(leaves, [SENSOR, "_row"], "left")
    steps = steps.withColumn("_step", F.lit(1) - F.coalesce("_left", F.lit(0)))
    summed = with_running_sum(steps, [SENSOR], "_row", "_step")
    return summed.select(*names, F.col("_sum").alias("flow_count"))


def in_range(
    rows: DataFrame, start: float | None = None, end: float | None = None
) -> DataFrame:
    """Rows between two epochs, both included; an open end is None."""
    if start is not None:
        rows = rows.filter(F.col("ts_epoch") >= start)
    if end is not None:
        rows = rows.filter(F.col("ts_epoch") <= end)
    return rows


def read_flows(
    rows: DataFrame, schema: str, start: float | None = None, end: float | None = None
) -> DataFrame:
    """Flows of a time range, oldest first, ties by their text; ``schema`` of the payload."""
    ordered = in_range(rows, start, end).orderBy("ts_epoch", "payload")
    return ordered.select("ts_epoch", F.from_json("payload", schema).alias("flow")).select(
        "ts_epoch", "flow.*"
    )


def prune(
    rows: DataFrame, now: float, retention: float = BUFFER_RETENTION_SECONDS
) -> tuple[DataFrame, DataFrame]:
    """(rows at or after the cutoff, one-row table with ``removed``)."""
    cutoff = now - retention
    removed = rows.agg(F.count(F.when(F.col("ts_epoch") < cutoff, 1)).alias("removed"))
    return rows.filter(F.col("ts_epoch") >= cutoff), removed


def buffer_stats(rows: DataFrame) -> DataFrame:
    """One row: count, oldest, newest, span; only the count for an empty buffer."""
    return rows.agg(
        F.count(F.lit(1)).alias("flow_count"),
        F.min("ts_epoch").alias("oldest"),
        F.max("ts_epoch").alias("newest"),
        (F.max("ts_epoch") - F.min("ts_epoch")).alias("span"),
    )


def oldest(rows: DataFrame, count: int = 5) -> DataFrame:
    return rows.orderBy("ts_epoch", "payload").limit(count)


def newest(rows: DataFrame, count: int = 5) -> DataFrame:
    return rows.orderBy(F.desc("ts_epoch"), F.desc("payload")).limit(count)


def _flow_map(payload: Column) -> Column:
    return F.from_json(payload, "map<string,string>")


def _flow_line(flow: Column) -> Column:
    def show(name: str) -> Column:
        given = F.coalesce(F.try_element_at(flow, F.lit(name)), F.lit("None"))
        return F.when(F.map_contains_key(flow, F.lit(name)), given).otherwise("N/A")

    text = F.format_string(
        "[%s] %s:%s -> %s:%s (%s)",
        *[show(n) for n in ("timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "protocol")],
    )
    return F.when(flow.isNull(), "Invalid JSON").otherwise(text)


def flow_text(payload: Column) -> Column:
    """One-line summary of a buffered flow: '[time] src:port -> dst:port (protocol)'."""
    return _flow_line(_flow_map(payload))


def listing(rows: DataFrame) -> DataFrame:
    """Rows as the inspection report shows them."""
    # The text is parsed once, not for each of its fields.
    parsed = computed_once(rows.select("ts_epoch", "payload"), "_flow", _flow_map(F.col("payload")))
    return parsed.select(
        "ts_epoch",
        millisecond_text(F.col("ts_epoch")).alias("at"),
        _flow_line(F.col("_flow")).alias("flow"),
    )


def empty_buffer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BUFFER_SCHEMA)


def append_buffer(rows: DataFrame, table: str) -> None:
    rows.write.mode("append").parquet(table)


def append_flows(flows: DataFrame, table: str, **how) -> None:
    """Append a batch of flows that have no arrival order of their own.

    They arrive after everything in the table, in their own order, so neither order nor
    default ids meet those of earlier batches. ``how`` goes to :func:`buffer_rows`. One
    writer per table.
    """
    last = load_buffer(flows.sparkSession, table).agg(F.max("arrival_seq")).first()[0]
    offset = F.lit(0 if last is None else last + 1).cast("bigint")
    append_buffer(buffer_rows(flows, seq=offset + F.monotonically_increasing_id(), **how), table)


def load_buffer(spark: SparkSession, table: str) -> DataFrame:
    """Rows of a buffer table; none where it does not exist."""
    return spark.read.parquet(table) if files.exists(spark, table) else empty_buffer(spark)


def clear_buffer(spark: SparkSession, table: str) -> None:
    """Leave the buffer table with its schema and no rows."""
    empty_buffer(spark).write.mode("overwrite").parquet(table)
