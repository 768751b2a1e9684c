"""Removal of expired event files.

What is written below ``date=/slot=`` was written while its slot lasted, so a slot that ended
before the limit goes as a folder, by its name alone; only the slot that the limit falls into
is looked at file by file.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans import files
from tidewatch.schemas import EVENT_RETENTION_MINUTES, EVENT_ROTATION_MINUTES

# Rotated event text, whether named by slot or by a Spark writer.
EVENT_FILES = "{*.jsonl,part-*.txt}"


def expired_files(
    spark: SparkSession,
    folder: str,
    retention_minutes: float = EVENT_RETENTION_MINUTES,
    now: float | None = None,
    pattern: str = EVENT_FILES,
) -> DataFrame:
    """Event files strictly older than the limit: ``path, modified``. No content is read."""
    if not files.exists(spark, folder):
        return spark.createDataFrame([], "path string, modified timestamp")
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", F.col("modificationTime").alias("modified"))
    )
    if retention_minutes <= 0:
        return listing.limit(0)
    cutoff = (time.time() if now is None else now) - retention_minutes * 60
    return listing.filter(F.unix_micros("modified") / F.lit(1e6) < cutoff)


def clean_expired(
    spark: SparkSession,
    folder: str,
    retention_minutes: float = EVENT_RETENTION_MINUTES,
    now: float | None = None,
    dry_run: bool = False,
) -> int:
    """Delete expired event files, then folders left empty; returns the count of files.

    A missing folder has none.

    The paths come one partition at a time, never as one list. ``dry_run`` only counts.
    """
    expired = expired_files(spark, folder, retention_minutes, now)
    if retention_minutes <= 0:
        return 0
    if dry_run:
        return expired.count()
    removed = sum(files.delete(spark, row.path) for row in expired.toLocalIterator())
    for path, is_folder in list(files.children(spark, folder)):
        if is_folder:
            _drop_empty(spark, path)
    return removed


def slots_of(
    spark: SparkSession, folder: str, rotation_minutes: int = EVENT_ROTATION_MINUTES
) -> DataFrame:
    """Slot folders: ``path, begins, ends``, from their names. An hour's last slot ends with it."""
    paths = [
        (slot,)
        for day, is_day in files.children(spark, folder) if is_day and "/date=" in day
        for slot, is_slot in files.children(spark, day) if is_slot and "/slot=" in slot
    ]
    named = spark.createDataFrame(paths, "path string")
    day, slot = (F.regexp_extract("path", p, 1) for p in (r"/date=([0-9-]{10})/", r"/slot=([0-9]{2}-[0-9]{2})$"))
    begins = F.to_timestamp(F.concat_ws(" ", day, slot), "yyyy-MM-dd HH-mm")
    minutes = F.least(F.minute(begins) + F.lit(max(1, int(rotation_minutes))), F.lit(60)) - F.minute(begins)
    return named.select("path", begins.alias("begins")).withColumn(
        "ends", F.timestamp_seconds(F.unix_seconds("begins") + 60 * minutes)
    )


def expired_slots(
    spark: SparkSession,
    folder: str,
    retention_minutes: float = EVENT_RETENTION_MINUTES,
    now: float | None = None,
    rotation_minutes: int = EVENT_ROTATION_MINUTES,
) -> DataFrame:
    """Slots of :func:`slots_of` that ended before the limit."""
    slots = slots_of(spark, folder, rotation_minutes)
    if retention_minutes <= 0:
        return slots.limit(0)
    cutoff = (time.time() if now is None else now) - retention_minutes * 60
    return slots.filter(F.unix_micros("ends") / F.lit(1e6) < cutoff)


def clean_slots(
    spark: SparkSession,
    folder: str,
    retention_minutes: float = EVENT_RETENTION_MINUTES,
    now: float | None = None,
    rotation_minutes: int = EVENT_ROTATION_MINUTES,
) -> int:
    """Delete expired slots whole, then expired files of the slot at the limit and folders left
    empty; returns the count of data files deleted."""
    if retention_minutes <= 0:
        return 0
    now = time.time() if now is None else now
    removed = 0
    for row in expired_slots(spark, folder, retention_minutes, now, rotation_minutes).toLocalIterator():
        removed += sum(not name.rsplit("/", 1)[-1].startswith((".", "_")) for name, _ in files.children(spark, row.path))
        files.delete(spark, row.path)
    edge = F.timestamp_seconds(F.lit(now - retention_minutes * 60))
    at_limit = slots_of(spark, folder, rotation_minutes).filter((F.col("begins") <= edge) & (F.col("ends") >= edge))
    for row in at_limit.collect():  # one slot, two where the limit is the border
        removed += clean_expired(spark, row.path, retention_minutes, now)
    for path, is_folder in list(files.children(spark, folder)):
        if is_folder:
            _drop_empty(spark, path)
    return removed


def _drop_empty(spark: SparkSession, folder: str) -> bool:
    """Delete a folder that holds nothing but empty folders; a date of empty slots goes whole."""
    kept = False
    for path, is_folder in list(files.children(spark, folder)):
        kept = not (is_folder and _drop_empty(spark, path)) or kept
    return not kept and files.delete(spark, folder)
