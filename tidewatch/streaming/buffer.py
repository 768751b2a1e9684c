"""Rolling buffer and flow archive fed by a stream.

The buffer is a table that batches only append to, so the work of a batch follows the batch:

- ``rows/slot=/batch=``: buffer rows by the slot of their event time;
- ``tops/batch=``: for each slot, sensor and chunk of arrivals of the batch its first and last
  arrival and its newest time;
- ``open/batch=``: a mark that stands while a batch is put in, and stays if that fails.

What has expired follows from the few rows of ``tops``: a slot of a batch goes, as a folder,
once later arrivals have passed all of it. A reader meets the rows that are left with the
newest later times, so the result is that of inserting every flow one by one.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators.buffer import ARRIVAL, BUFFER_SCHEMA, SENSOR, buffer_rows, empty_buffer, survivors
from tidewatch.operators.rotation import slot_date, slot_key
from tidewatch.plans import files
from tidewatch.plans.materialize import temporary_tables, written
from tidewatch.plans.ordered import CHUNK_BITS, chunk_later_max
from tidewatch.schemas import BUFFER_RETENTION_SECONDS, FLOW_ROTATION_MINUTES
from tidewatch.sources.sinks import select_fields

logger = logging.getLogger(__name__)

# Flows of one batch that can have an arrival position of their own; 2**30 batches fit.
BATCH_BITS = 33
_TOPS = f"slot bigint, {SENSOR} string, _chunk bigint, _first bigint, _last bigint, _top double"


def batch_rows(flows: DataFrame, batch_id: int, **how) -> DataFrame:
    """Buffer rows of a batch whose flows have no arrival order: after all earlier batches, in
    the order of the batch. ``how`` goes to :func:`buffer_rows`."""
    placed = written(flows.withColumn(ARRIVAL, F.monotonically_increasing_id()), "batch-flows")
    placed = placed.withColumn("_task", F.shiftright(ARRIVAL, 33))
    # One row a task: where its flows begin in the batch.
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_task").count().select(
        "_task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )
    first = F.lit(batch_id << BATCH_BITS).cast("bigint")
    within = F.col("_start") + F.col(ARRIVAL).bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(F.broadcast(starts), "_task").withColumn(ARRIVAL, first + within)
    return buffer_rows(numbered.drop("_task", "_start"), **how)


def open_batches(spark: SparkSession, folder: str) -> list[int]:
    """Batches that were begun and not finished, oldest first."""
    names = (path.rsplit("/", 1)[-1] for path, _ in files.children(spark, f"{folder}/open"))
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def put_batch(
    rows: DataFrame,
    batch_id: int,
    folder: str,
    retention: float = BUFFER_RETENTION_SECONDS,
    supplied_ids: bool = False,
) -> None:
    """Append a batch to the buffer and drop what it has made expire. A replay of the batch
    replaces its own files."""
    spark = rows.sparkSession
    mark = f"{folder}/open/batch={batch_id}"
    files.make_folder(spark, mark)
    with temporary_tables(spark):
        slot = F.floor(F.col("ts_epoch") / F.lit(float(max(retention, 1)))).alias("slot")
        placed = written(rows.select("*", slot), "batch-rows")
        parted = placed.withColumn("batch", F.lit(batch_id)).repartition("slot", F.shiftright("arrival_seq", CHUNK_BITS[0]))
        writer = parted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("slot", "batch").parquet(f"{folder}/rows")
        chunk = F.shiftright("arrival_seq", CHUNK_BITS[0]).alias("_chunk")
        tops = placed.groupBy("slot", SENSOR, chunk).agg(
            F.min("arrival_seq").alias("_first"),
            F.max("arrival_seq").alias("_last"),
            F.max("ts_epoch").alias("_top"),
        )
        tops.write.mode("overwrite").parquet(f"{folder}/tops/batch={batch_id}")
        files.delete(spark, mark)
        drop_expired(spark, folder, retention, supplied_ids)


def _tops(spark: SparkSession, folder: str) -> DataFrame | None:
    """Newest times of finished batches, with their batch; None before the first."""
    if not any(True for _ in files.children(spark, f"{folder}/tops")):
        return None
    read = spark.read.schema(f"{_TOPS}, batch bigint").parquet(f"{folder}/tops")
    return read.filter(~F.col("batch").isin(open_batches(spark, folder)))


def _chunk_tops(tops: DataFrame) -> DataFrame:
    return written(tops.groupBy(SENSOR, "_chunk").agg(F.max("_top").alias("_top")), "buffer-tops")


def drop_expired(
    spark: SparkSession,
    folder: str,
    retention: float = BUFFER_RETENTION_SECONDS,
    supplied_ids: bool = False,
) -> int:
    """Delete the slots of batches in which nothing can survive; how many were deleted.

    Whoever outlives a flow is newer, so leaving expired flows out changes no later result.
    With supplied ids an expired flow still hides its earlier inserts; batches then go whole
    and oldest first.
    """
    tops = _tops(spark, folder)
    if tops is None:
        return 0
    # The newest time of all parts that begin after a part's last arrival.
    begins = tops.select(SENSOR, F.col("_first").alias("_chunk"), "_top")
    ends = tops.select(SENSOR, F.col("_last").alias("_chunk"), F.lit(None).cast("double").alias("_top"))
    later = chunk_later_max(_chunk_tops(begins.unionByName(ends)), [SENSOR], (0, *CHUNK_BITS))
    later = later.withColumnRenamed("_chunk", "_last")
    alive = F.col("_later").isNull() | (F.col("_top") >= F.col("_later") - retention)
    state = tops.join(later, [SENSOR, "_last"]).groupBy("batch", "slot").agg(F.max(alive).alias("alive"))
    slots = state.orderBy("batch", "slot").collect()  # one row for each live folder
    first_alive = min((r["batch"] for r in slots if r["alive"]), default=1 << 62)

    def goes(r) -> bool:
        return not r["alive"] and (not supplied_ids or r["batch"] < first_alive)

    gone = [r for r in slots if goes(r)]
    for r in gone:
        files.delete(spark, f"{folder}/rows/slot={r['slot']}/batch={r['batch']}")
    for batch in {r["batch"] for r in gone} - {r["batch"] for r in slots if not goes(r)}:
        files.delete(spark, f"{folder}/tops/batch={batch}")
    for slot in {r["slot"] for r in gone}:
        path = f"{folder}/rows/slot={slot}"
        if not any(True for _ in files.children(spark, path)):
            files.delete(spark, path)
    return len(gone)


def read_buffer(
    spark: SparkSession,
    folder: str,
    retention: float = BUFFER_RETENTION_SECONDS,
    supplied_ids: bool = False,
) -> DataFrame:
    """Current content of a streamed buffer, with the rules it is written by."""
    tops = _tops(spark, folder)
    if tops is None:
        return empty_buffer(spark)
    names = [c.split()[0] for c in BUFFER_SCHEMA.split(", ")]
    read = spark.read.schema(f"{BUFFER_SCHEMA}, slot bigint, batch bigint").parquet(f"{folder}/rows")
    rows = read.filter(~F.col("batch").isin(open_batches(spark, folder))).select(*names)
    return survivors(rows, retention, supplied_ids, tops=_chunk_tops(tops)).select(*names)


def write_archive(
    flows: DataFrame,
    batch_id: int,
    folder: str,
    fields: str | None = None,
    rotation_minutes: int = FLOW_ROTATION_MINUTES,
) -> None:
    """CSV archive of one batch below ``date=/slot=/batch=``; a replay replaces it.

    ``_at`` is the batch time that Spark records with the batch's offsets.
    """
    chosen = select_fields(flows.drop("_at"), fields).columns
    dated = flows.select(
        *[F.col(f"`{c}`") for c in chosen],
        slot_date(F.col("_at")).alias("date"),
        slot_key(F.col("_at"), rotation_minutes).alias("slot"),
        F.lit(batch_id).alias("batch"),
    )
    writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date", "slot", "batch").csv(folder, header=True)


def archived_batch(
    spark: SparkSession, folder: str, batch_id: int, schema, fields: str | None = None
) -> DataFrame:
    """Flows of a batch as the archive has them; fields that it was not given are null."""
    empty = spark.createDataFrame([], schema)
    chosen = select_fields(empty, fields)
    read = spark.read.schema(chosen.schema).option("header", True)
    found = read.csv(f"{folder}/date=*/slot=*/batch={batch_id}")
    return empty.unionByName(found, allowMissingColumns=True)


def dual_writer(
    archive: str,
    buffer: str,
    to_rows: Callable[[DataFrame], DataFrame] | None = None,
    retention: float = BUFFER_RETENTION_SECONDS,
    fields: str | None = None,
    rotation_minutes: int = FLOW_ROTATION_MINUTES,
    supplied_ids: bool = False,
) -> Callable[[DataFrame, int], None]:
    """Batch function: archive first, then the buffer, whose failure never stops the archive.

    ``to_rows`` makes buffer rows of flows that bring their own arrival order; without it they
    arrive in the order of batches. A batch that failed to enter the buffer is made up from
    the archive with the next one.
    """

    def put(flows: DataFrame, batch_id: int) -> None:
        make = to_rows or partial(batch_rows, batch_id=batch_id)
        with temporary_tables(flows.sparkSession):
            put_batch(make(flows), batch_id, buffer, retention, supplied_ids)

    def write(flows: DataFrame, batch_id: int) -> None:
        if flows.isEmpty():
            return
        spark = flows.sparkSession
        write_archive(flows, batch_id, archive, fields, rotation_minutes)
        plain = flows.drop("_at")
        try:
            # Marked before anything of it is made, so that a failure is remembered.
            files.make_folder(spark, f"{buffer}/open/batch={batch_id}")
            missed = [b for b in open_batches(spark, buffer) if b < batch_id]
        except Exception:
            logger.exception("buffer of batch %s cannot be reached", batch_id)
            return
        for b in [*missed, batch_id]:
            try:
                again = b != batch_id
                put(archived_batch(spark, archive, b, plain.schema, fields) if again else plain, b)
            except Exception:
                logger.exception("buffer update of batch %s failed", b)

    return write


def without_replays(flows: DataFrame, event_time: str, delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of a caller-supplied ``_id`` within the watermark delay."""
    return flows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_id"])


def start_dual_sink(
    flows: DataFrame,
    archive: str,
    buffer: str,
    checkpoint: str,
    available_now: bool = False,
    **options,
) -> StreamingQuery:
    """Run the archive and the buffer on a stream of flows."""
    stamped = flows.withColumn("_at", F.current_timestamp())
    writer = stamped.writeStream.foreachBatch(dual_writer(archive, buffer, **options))
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 second"}
    return writer.trigger(**trigger).start()
