"""Buffer tables laid out by time, with an index of the times in each file.

Files hold neighbouring times, and a small table says of each file its least and largest time
and how many flows it has. A time range, or the oldest or newest few flows, then open only
the files that can hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators.buffer import BUFFER_SCHEMA, in_range, newest, oldest
from tidewatch.plans import files
from tidewatch.plans.materialize import written_bytes

ZONES = "file string, least double, largest double, flows bigint"
# Bytes of a written file that a range task should make.
FILE_BYTES = 128 * 1024 * 1024


def write_by_time(rows: DataFrame, table: str, parts: int | None = None) -> None:
    """Write a buffer table in ranges of time, and its index. ``parts`` files are aimed at, by
    default as many as the rows' planned size needs."""
    spark = rows.sparkSession
    if parts is None:
        parts = max(1, min(1 << 16, written_bytes(rows) // FILE_BYTES))
    ordered = rows.repartitionByRange(parts, "ts_epoch").sortWithinPartitions("ts_epoch", "payload")
    ordered.write.parquet(f"{table}/rows")
    # Only the time column is read back.
    read = spark.read.schema(BUFFER_SCHEMA).parquet(f"{table}/rows")
    zones = read.select(F.col("_metadata.file_path").alias("file"), "ts_epoch").groupBy("file").agg(
        F.min("ts_epoch").alias("least"), F.max("ts_epoch").alias("largest"), F.count(F.lit(1)).alias("flows")
    )
    zones.coalesce(1).write.parquet(f"{table}/zones")


def zones_of(spark: SparkSession, table: str) -> DataFrame:
    """One row for each file with flows."""
    if not files.exists(spark, f"{table}/zones"):
        return spark.createDataFrame([], ZONES)
    return spark.read.schema(ZONES).parquet(f"{table}/zones")


def _rows_of(spark: SparkSession, zones: DataFrame) -> DataFrame:
    paths = [r["file"] for r in zones.select("file").collect()]  # names of the files to open
    read = spark.read.schema(BUFFER_SCHEMA)
    return read.parquet(*paths) if paths else spark.createDataFrame([], BUFFER_SCHEMA)


def rows_between(
    spark: SparkSession, table: str, start: float | None = None, end: float | None = None
) -> DataFrame:
    """Rows between two epochs, both included, from the files that meet the range."""
    zones = zones_of(spark, table)
    if start is not None:
        zones = zones.filter(F.col("largest") >= start)
    if end is not None:
        zones = zones.filter(F.col("least") <= end)
    return in_range(_rows_of(spark, zones), start, end)


def _reaching(zones: DataFrame, count: int, near: str, far: str, sign: int) -> DataFrame:
    """Files that can hold one of the first ``count`` flows, seen from one end of time.

    The files whose far ends come first and that hold ``count`` flows together bound the
    place of the last of these flows; whatever begins beyond it is out.
    """

    def order(name: str) -> Column:
        return F.col(name) * sign

    summed = F.sum("flows").over(Window.orderBy(order(far), "file"))
    bound = zones.withColumn("_sum", summed).filter(F.col("_sum") >= count).agg(F.min(order(far)).alias("_bound"))
    kept = zones.join(F.broadcast(bound)).filter(F.col("_bound").isNull() | (order(near) <= F.col("_bound")))
    return kept.drop("_bound")


def oldest_of(spark: SparkSession, table: str, count: int = 5) -> DataFrame:
    return oldest(_rows_of(spark, _reaching(zones_of(spark, table), count, "least", "largest", 1)), count)


def newest_of(spark: SparkSession, table: str, count: int = 5) -> DataFrame:
    return newest(_rows_of(spark, _reaching(zones_of(spark, table), count, "largest", "least", -1)), count)
