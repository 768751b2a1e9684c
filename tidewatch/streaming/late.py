"""Late rows of a stream as output of their own.

A row is late if its window has closed, that is, if the window's end is not beyond the newest
time of all earlier batches less the delay. This is the rule by which windowed aggregation
drops rows; here they are written aside and counted. What a batch needs to know of the
batches before it is one row, written anew by each batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators.flows import TIME_COLUMN
from tidewatch.plans import files
from tidewatch.plans.materialize import temporary_tables, written

STATE = "newest timestamp, rows bigint, late_rows bigint"


def _states(spark: SparkSession, folder: str) -> list[int]:
    """Batches whose state is complete, oldest first."""
    found = []
    for path, _ in files.children(spark, f"{folder}/state"):
        if files.exists(spark, f"{path}/_SUCCESS"):
            found.append(int(path.rsplit("batch=", 1)[-1]))
    return sorted(found)


def _state_before(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    known = [b for b in _states(spark, folder) if b < batch_id]
    if not known:
        return spark.createDataFrame([(None, 0, 0)], STATE)
    return spark.read.schema(STATE).parquet(f"{folder}/state/batch={known[-1]}")


def late_writer(
    folder: str,
    window_size: str = "1 minute",
    delay: str = "1 minute",
    time_column: str = TIME_COLUMN,
    on_time: Callable[[DataFrame, int], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """Batch function: late rows go below ``late/batch=``, the others to ``on_time``.

    A replayed batch replaces its own late rows and state. Rows without a time belong to no
    window and are on time.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        with temporary_tables(spark):
            before = _state_before(spark, folder, batch_id)
            mark = before.select((F.col("newest") - F.expr(f"INTERVAL {delay}")).alias("_mark"))
            ends = F.window(F.col(time_column), window_size)["end"]
            placed = rows.filter(F.col(time_column).isNotNull()).withColumn("_ends", ends)
            none = rows.filter(F.col(time_column).isNull()).withColumn("_ends", F.lit(None).cast("timestamp"))
            # One row of state beside every row: its value is read from a table, not the plan.
            marked = placed.unionByName(none).join(F.broadcast(mark))
            late = F.coalesce(F.col("_ends") <= F.col("_mark"), F.lit(False)).alias("_late")
            split = written(marked.select(*[F.col(f"`{c}`") for c in rows.columns], late), "late-split")
            split.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
            if on_time is not None:
                on_time(split.filter("not _late").drop("_late"), batch_id)
            sums = split.agg(
                F.max(time_column).cast("timestamp").alias("newest"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if("_late").alias("late_rows"),
            )
            both = before.unionByName(sums).agg(F.max("newest").alias("newest"), F.sum("rows").alias("rows"), F.sum("late_rows").alias("late_rows"))
            both.coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")
        # The state before this one stays for a replay.
        for old in [b for b in _states(spark, folder) if b < batch_id][:-1]:
            files.delete(spark, f"{folder}/state/batch={old}")

    return write


def start_late_split(
    flows: DataFrame, folder: str, checkpoint: str, available_now: bool = False, **options
) -> StreamingQuery:
    """Part a stream into late rows and others; ``options`` go to :func:`late_writer`."""
    writer = flows.writeStream.foreachBatch(late_writer(folder, **options))
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 second"}
    return writer.trigger(**trigger).start()


def read_late(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All late rows so far."""
    if not files.exists(spark, f"{folder}/late"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/late")


def late_counts(spark: SparkSession, folder: str) -> DataFrame:
    """One row: newest time, rows and late rows of all batches, over restarts."""
    return _state_before(spark, folder, 1 << 62)
