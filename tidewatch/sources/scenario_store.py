"""Stored detection results: one metadata row and the scored windows per scenario.

Every save is a version of its own: both tables are written below ``version=...`` and only then
a marker file is put into ``published``. Readers follow the markers, and of a scenario they take
its newest version, so both tables change at once, whatever breaks on the way. A marker has
no content; that it is there is enough, and making a file is atomic on all file systems, as a
rename is not. Two writers take different versions and cannot lose each other's scenarios.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.plans import files

SCENARIO = "scenario_id"
VERSION = "version"
META, WINDOWS = "scenario_meta", "scenario_windows"


class ScenarioNotFoundError(LookupError):
    """No scenario of that id."""


class StepOutOfRangeError(IndexError):
    """The scenario has no such step."""


def published(spark: SparkSession, store: str) -> list[str]:
    """Versions that readers see, oldest first."""
    return sorted(path.rsplit("/", 1)[-1] for path, _ in files.children(spark, f"{store}/published"))


def _folder(store: str, table: str, version: str) -> str:
    return f"{store}/{table}/{VERSION}={version}"


def _schemas(store: str, version: str) -> str:
    return f"{store}/schemas/{version}.json"


def _delete(spark: SparkSession, store: str, version: str) -> None:
    for path in (*(_folder(store, t, version) for t in (META, WINDOWS)), _schemas(store, version)):
        files.delete(spark, path)


def save_scenarios(metadata: DataFrame, windows: DataFrame, store: str) -> str:
    """Insert or replace scenarios, both tables at once; those in neither stay untouched.

    A scenario with metadata and no windows loses the windows it had; one with windows only
    keeps its metadata. Both tables carry ``scenario_id``, which is not null. Returns the version.
    """
    spark = metadata.sparkSession
    number = max((int(v.split("-")[0]) for v in published(spark, store)), default=0) + 1
    version = f"{number:012d}-{uuid.uuid4().hex}"
    tables = {WINDOWS: windows, META: metadata}
    try:
        for table, df in tables.items():
            # Few files per scenario; a large one is split over several tasks.
            rows = df.hint("rebalance", SCENARIO)
            rows.write.partitionBy(SCENARIO).parquet(_folder(store, table, version))
        shapes = {table: df.schema.jsonValue() for table, df in tables.items()}
        files.write_bytes(spark, _schemas(store, version), json.dumps(shapes).encode())
    except Exception:
        _delete(spark, store, version)
        raise
    files.write_bytes(spark, f"{store}/published/{version}", b"")
    return version


def _rows(spark: SparkSession, store: str, table: str, versions: list[str]) -> DataFrame:
    """Rows of all versions of a table, with their version; columns as in the newest."""
    shape = json.loads(files.read_bytes(spark, _schemas(store, versions[-1])))[table]
    schema = T.StructType.fromJson(shape)
    if VERSION not in schema.names:
        schema = schema.add(VERSION, "string")
    read = spark.read.schema(schema).option("basePath", f"{store}/{table}")
    return read.parquet(*[_folder(store, table, v) for v in versions])


def _newest(ids: DataFrame) -> DataFrame:
    return ids.groupBy(SCENARIO).agg(F.max(VERSION).alias(VERSION))


def _current(spark: SparkSession, store: str, versions: list[str]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """For each table its rows of all versions, and the version that counts for each scenario."""
    meta, windows = (_rows(spark, store, t, versions) for t in (META, WINDOWS))
    named = meta.select(SCENARIO, VERSION)
    # Only folder names are looked at; no column of the windows is read.
    either = named.unionByName(windows.select(SCENARIO, VERSION))
    return {META: (meta, _newest(named)), WINDOWS: (windows, _newest(either))}


def load_table(spark: SparkSession, store: str, table: str) -> DataFrame | None:
    """A store table as last published, or None where nothing was saved yet."""
    versions = published(spark, store)
    if not versions:
        return None
    if len(versions) == 1:
        return _rows(spark, store, table, versions).drop(VERSION)
    rows, newest = _current(spark, store, versions)[table]
    return rows.join(newest, [SCENARIO, VERSION]).drop(VERSION)


def drop_superseded(spark: SparkSession, store: str) -> int:
    """Delete versions of which no scenario counts any more; returns how many.

    At most one version per scenario is left. Jobs that still read an old version fail, so
    run it when none does.
    """
    versions = published(spark, store)
    if len(versions) < 2:
        return 0
    parts = _current(spark, store, versions)
    counting = parts[META][1].select(VERSION).unionByName(parts[WINDOWS][1].select(VERSION))
    alive = {row[0] for row in counting.distinct().toLocalIterator()}
    gone = [v for v in versions if v not in alive]
    for version in gone:
        files.delete(spark, f"{store}/published/{version}")
        _delete(spark, store, version)
    return len(gone)


def list_scenarios(spark: SparkSession, store: str) -> DataFrame:
    """Id, name and target of every scenario; no rows for an absent store."""
    meta = load_table(spark, store, META)
    if meta is None:
        return spark.createDataFrame([], "id string, name string, target string")
    return meta.select(
        F.col(SCENARIO).alias("id"), "name", F.col("target_asset").alias("target")
    )


def scenario_step(spark: SparkSession, store: str, scenario_id: str, step: int) -> DataFrame:
    """One window with its scenario's metadata and step count; reads that scenario's folders."""
    meta = load_table(spark, store, META)
    found = None if meta is None else meta.filter(F.col(SCENARIO) == scenario_id)
    if found is None or found.isEmpty():
        raise ScenarioNotFoundError(scenario_id)
    windows = load_table(spark, store, WINDOWS).filter(F.col(SCENARIO) == scenario_id)
    total = windows.count()
    if not 0 <= step < total:
        raise StepOutOfRangeError(f"step {step} of {total}")
    current = windows.filter(F.col("step_index") == step).withColumn(
        "total_steps", F.lit(total).cast("bigint")
    )
    return current.join(found, SCENARIO)


def steps_with_metadata(metadata: DataFrame, windows: DataFrame) -> DataFrame:
    """Every window beside its scenario's metadata."""
    return windows.join(metadata, SCENARIO)
