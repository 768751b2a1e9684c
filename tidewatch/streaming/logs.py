"""Continuous normalisation of sensor logs into rotated event text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators.normalize import all_events
from tidewatch.operators.rotation import slot_date, slot_key
from tidewatch.plans import files
from tidewatch.plans.materialize import temporary_tables, written
from tidewatch.schemas import EVENT_ROTATION_MINUTES
from tidewatch.sources.zeek import LOG_FILES, header_states, parse_log

COUNTS = "events bigint"


def log_stream(
    spark: SparkSession,
    folder: str,
    pattern: str = LOG_FILES,
    since: float | None = None,
) -> DataFrame:
    """Lines of closed log files as they appear. ``since`` (epoch seconds) skips files last
    changed before it, so a first start can begin at 'now'."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    lines = reader.option("pathGlobFilter", pattern).text(folder).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_modification_time").alias("modified"),
        "value",
        F.current_timestamp().alias("at"),
    )
    if since is not None:
        lines = lines.filter(F.unix_micros("modified") >= int(since * 1e6))
    return lines


def event_writer(
    out: str,
    rotation_minutes: int = EVENT_ROTATION_MINUTES,
    totals: dict | None = None,
    counts: str | None = None,
    headers: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """Batch function: parse, normalise, write below ``date=/slot=/batch=``.

    The slot comes from the batch time that Spark records with the offsets, so a replayed
    batch replaces its own files. ``totals['events']`` counts events written by this process;
    below ``counts`` each batch leaves what it wrote, so the sum holds over restarts.
    ``headers`` is for files that come in parts: the header in force at the end of each file is
    kept there, and leads the file's lines in later batches.
    """

    def write(lines: DataFrame, batch_id: int) -> None:
        if lines.isEmpty():
            return
        at = lines.select("at").first()["at"]
        ordered = lines.select(
            "file",
            "block",
            (F.col("pos") if "pos" in lines.columns else F.monotonically_increasing_id()).alias("pos"),
            F.regexp_replace("value", "[\\n\\r]+$", "").alias("value"),
        )
        counted = Observation()
        with temporary_tables(lines.sparkSession):
            if headers is not None:
                ordered = with_known_headers(written(ordered, "log-part"), headers, batch_id)
            events = all_events(parse_log(ordered))
            stamped = events.observe(counted, F.count(F.lit(1)).alias("n")).select(
                F.col("json").alias("value"),
                slot_date(F.lit(at)).alias("date"),
                slot_key(F.lit(at), rotation_minutes).alias("slot"),
                F.lit(batch_id).alias("batch"),
            )
            writer = stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("date", "slot", "batch").text(out)
        if counts is not None:
            row = lines.sparkSession.createDataFrame([(counted.get["n"],)], COUNTS)
            row.coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={batch_id}")
        if totals is not None:
            totals["events"] = totals.get("events", 0) + counted.get["n"]

    return write


HEADERS = "file string, lines array<string>"


def with_known_headers(lines: DataFrame, folder: str, batch_id: int) -> DataFrame:
    """Lines of a batch, those of each file led by the header that earlier batches left for it;
    what now holds at the end of each file is kept for the next batch.

    The table has a row for each file and a version for each batch; a replayed batch reads the
    version before it and replaces its own.
    """
    spark = lines.sparkSession
    versions = sorted(
        int(path.rsplit("batch=", 1)[-1]) for path, _ in files.children(spark, folder) if files.exists(spark, f"{path}/_SUCCESS")
    )
    earlier = [v for v in versions if v < batch_id]
    if earlier:
        known = spark.read.schema(HEADERS).parquet(f"{folder}/batch={earlier[-1]}")
    else:
        known = spark.createDataFrame([], HEADERS)
    met = lines.select("file").distinct()
    lead = known.join(met, "file", "left_semi").select("file", F.posexplode("lines").alias("pos", "value"))
    lead = lead.select("file", F.lit(-1).cast("bigint").alias("block"), F.col("pos").cast("bigint").alias("pos"), "value")
    led = lines.unionByName(lead)
    states = header_states(led).groupBy("file").agg(
        F.max_by(F.struct("*"), F.struct("block", "from_pos")).alias("s")
    )
    sep = F.col("s.separator")
    code = F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(F.ascii(sep))), 2, "0"))
    said = F.array(
        F.concat(F.lit("#separator "), F.when(F.length(sep) == 1, code).otherwise(sep)),
        *[F.concat(F.lit(f"#{n} "), F.col(f"s.{n}")) for n in ("set_separator", "empty_field", "unset_field", "path")],
        F.concat(F.lit("#fields"), F.when(sep.rlike("^\\s"), sep).otherwise(F.concat(F.lit(" "), sep)), F.expr("array_join(s.fields, s.separator)")),
    )
    now = states.select("file", F.filter(said, lambda line: line.isNotNull()).alias("lines"))
    rest = known.join(met, "file", "left_anti")
    now.unionByName(rest).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
    for old in earlier[:-1]:
        files.delete(spark, f"{folder}/batch={old}")
    return led


def event_count(spark: SparkSession, counts: str) -> DataFrame:
    """One row: events that all batches have written and how many batches there were."""
    if not files.exists(spark, counts):
        return spark.createDataFrame([(0, 0)], "events bigint, batches bigint")
    read = spark.read.schema(COUNTS).option("recursiveFileLookup", "true").parquet(counts)
    return read.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.count(F.lit(1)).alias("batches")
    )


def start_log_stream(
    lines: DataFrame,
    out: str,
    checkpoint: str,
    rotation_minutes: int = EVENT_ROTATION_MINUTES,
    available_now: bool = False,
    totals: dict | None = None,
    counts: str | None = None,
    headers: str | None = None,
) -> StreamingQuery:
    """Run the normaliser; a restart with the same checkpoint continues where it stopped."""
    writer = lines.writeStream.foreachBatch(event_writer(out, rotation_minutes, totals, counts, headers))
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 second"}
    return writer.trigger(**trigger).start()
