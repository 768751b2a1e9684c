"""Session settings every job in this package relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings that change results; applied to whatever session the caller brings.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.ansi.enabled": "true",
    # Folder values such as scenario ids and slots are text, whatever they look like.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}

# Settings for sessions built here; a cluster sets its own.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Windows packed per task before the aggregate turns to sorting; a state is a few kB.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1024",
    # State of open windows on disk rather than on the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # No call-site capture: it costs milliseconds per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on to an existing session."""
    for key, value in SEMANTIC_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app: str = "tidewatch", **conf: str) -> SparkSession:
    """Single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**DEFAULT_CONF, **SEMANTIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_fallbacks: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, for tables that cut a long lineage.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is used
    only where that is unset and driver and executors share one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    # A running session does not take that setting any more, so the folder is kept here.
    app = spark.sparkContext.applicationId
    if app not in _fallbacks:
        _fallbacks[app] = tempfile.mkdtemp(prefix="tidewatch-")
    return _fallbacks[app]
