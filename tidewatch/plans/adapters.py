"""The driver's tables seen as flows, buffer inserts and sensor logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.scorers import LinearScorer
from tidewatch.plans.materialize import written
from tidewatch.schemas import FLOW_COLUMNS, FLOW_TEXT_COLUMNS
from tidewatch.session import configure
from tidewatch.sources.bundle import Bundle, seeded_lstm_weights

# Model features of the narrow adapter. The last one has no source column.
FEATURES = [
    "Dst Port",
    "Protocol",
    "Flow Duration",
    "Tot Fwd Pkts",
    "Flow IAT Mean",
    "CWE Flag Count",
    "Idle Mean",
]
WIDE_FEATURES = [c for c in FLOW_COLUMNS if c not in FLOW_TEXT_COLUMNS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = table(spark, sf_dir, "events")
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def _protocol() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind.isin("view", "click"), 6)
        .when(kind == "purchase", 17)
        .when(kind == "signup", 1)
        .otherwise(0)
    )


def _port() -> Column:
    return (F.col("user_id") * 7919 + F.col("event_id")) % 65536


def narrow_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as flow records in file spelling, with unreadable and infinite numbers."""
    gap = (
        F.when(F.col("event_id") % 97 == 0, "Infinity")
        .when(F.col("event_id") % 89 == 0, "bad")
        .otherwise((F.col("value") / 10).cast("string"))
    )
    return events(spark, sf_dir).select(
        (F.col("user_id") % 4).alias("capture_id"),
        "event_id",
        F.col("ts").alias("timestamp"),
        _port().alias("dst_port"),
        _protocol().alias("protocol"),
        F.col("value").alias("flow_duration"),
        F.get_json_object("props", "$.k").alias("tot_fwd_pkts"),
        gap.alias("flow_iat_mean"),
        (F.col("event_id") % 3).alias("cwr_flag_count"),
    )


def wide_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as full 82-column flow records; numbers by formula from the event."""
    made = {
        "src_ip": "concat('10.0.0.', string(user_id % 256))",
        "dst_ip": "'192.168.1.100'",
        "src_port": "1024 + event_id % 50000",
        "dst_port": "port",
        "protocol": "protocol",
        "timestamp": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
    }
    for i, name in enumerate(FLOW_COLUMNS):
        made.setdefault(name, f"(event_id * {i + 3} + user_id) % 1009")
    base = events(spark, sf_dir).withColumns({"port": _port(), "protocol": _protocol()})
    return base.selectExpr(
        "user_id % 4 AS capture_id", *[f"{made[c]} AS {c}" for c in FLOW_COLUMNS]
    )


def _scaler(width: int) -> tuple[list[float], list[float]]:
    mean = [1.0 + 1.5 * (d % 7) for d in range(width)]
    scale = [2.0 + 0.5 * (d % 5) for d in range(width)]
    return mean, scale


def formula_bundle(features: list[str] = FEATURES, window_size: str = "1h") -> Bundle:
    """Bundle with parameters by formula, as no trained one exists here."""
    mean, scale = _scaler(4 * len(features) + 4)
    return Bundle(
        feature_cols=features,
        scaler_mean=mean,
        scaler_scale=scale,
        window_size=window_size,
        baseline={"mean": 0.18, "std": 0.06},
    )


def attack_weight(d: int) -> float:
    return ((d * 37) % 11 - 5) / 10


def class_weight(c: int, d: int) -> float:
    return (((c + 1) * (d + 3) * 17) % 13 - 6) / 10


LINEAR_BIAS, LINEAR_DECAY, LINEAR_DRIFT, CLASS_COUNT = -0.75, 0.9, 0.05, 7


def formula_scorer(width: int) -> LinearScorer:
    return LinearScorer(
        attack=[attack_weight(d) for d in range(width)],
        classes=[[class_weight(c, d) for d in range(width)] for c in range(CLASS_COUNT)],
        attack_bias=LINEAR_BIAS,
        decay=LINEAR_DECAY,
        drift=LINEAR_DRIFT,
    )


def small_weights(width: int) -> dict:
    return seeded_lstm_weights(width, hidden=32, layers=2)


# --- rolling buffer -----------------------------------------------------------------


def buffer_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as buffered flows; their time as ISO, day-first or epoch text in turn."""
    kind = F.col("event_id") % 3
    micros = F.unix_micros("ts")
    epoch = F.format_string("%d.%06d", F.floor(micros / 1000000), micros % 1000000)
    text = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 1, F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
        .otherwise(epoch)
    )
    return events(spark, sf_dir).select(
        "event_id",
        "user_id",
        text.alias("timestamp"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string")).alias("src_ip"),
        (1024 + F.col("event_id") % 50000).alias("src_port"),
        F.when(F.col("event_id") % 7 != 0, F.lit("192.168.1.100")).alias("dst_ip"),
        _port().alias("dst_port"),
        _protocol().alias("protocol"),
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("_id"),
    )


def shuffled_arrival() -> Column:
    """Arrival order far from time order."""
    return (F.col("event_id") * 7919) % 10007 * (1 << 40) + F.col("event_id")


def jittered_arrival() -> Column:
    """Arrival order near time order, with neighbours swapped."""
    near = F.col("event_id") + (F.col("event_id") * 7919) % 101
    return near * 128 + F.col("event_id") % 128


# --- sensor logs --------------------------------------------------------------------

# Log of each event type and its fields; the values are in log_values.
LOG_OF_TYPE = {
    "view": "conn",
    "click": "dns",
    "purchase": "http",
    "signup": "ssl",
    "error": "notice",
}
LOG_COMMON = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p"]
LOG_FIELDS = {
    "conn": ["proto", "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "conn_state"],
    "dns": ["proto", "query", "qclass_name", "qtype_name", "rcode_name", "answers"],
    "http": ["method", "host", "uri", "status_code", "user_agent"],
    "ssl": ["version", "server_name"],
    "notice": ["note", "msg"],
}
BLOCK_EVENTS = 4096


def log_values() -> dict[str, str]:
    """Field -> SQL text expression over an event, in terms both engines read."""
    port = "CAST((user_id * 7919 + event_id) % 65536 AS STRING)"
    number = "CAST({} AS STRING)"
    return {
        "ts": "CASE WHEN event_id % 23 = 0 THEN 'no-time' ELSE epoch_text END",
        "uid": "concat('C', " + number.format("event_id") + ")",
        "id.orig_h": "concat('10.0.0.', " + number.format("user_id % 256") + ")",
        "id.orig_p": f"CASE WHEN event_id % 11 = 0 THEN '-' WHEN event_id % 13 = 0 THEN '12.0' ELSE {port} END",
        "id.resp_h": "'192.168.1.100'",
        "id.resp_p": "CASE WHEN event_id % 5 = 0 THEN '(empty)' ELSE ' 443 ' END",
        "proto": "CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END",
        "duration": "CASE WHEN event_id % 7 = 0 THEN '1.5d' WHEN event_id % 9 = 0 THEN '-' ELSE cents_text END",
        "orig_bytes": number.format("event_id * 17 % 100003"),
        "resp_bytes": "CASE WHEN event_id % 6 = 0 THEN '1e3' ELSE " + number.format("event_id * 31") + " END",
        "orig_pkts": number.format("event_id % 40"),
        "resp_pkts": "CASE WHEN event_id % 10 = 0 THEN '' ELSE " + number.format("event_id % 60") + " END",
        "conn_state": "'SF'",
        "query": "concat('host', " + number.format("user_id") + ", '.example.com')",
        "qclass_name": "'C_INTERNET'",
        "qtype_name": "'A'",
        "rcode_name": "CASE WHEN event_id % 4 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END",
        "answers": "'10.1.1.1,10.1.1.2'",
        "method": "CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END",
        "host": "'example.com'",
        "uri": "concat('/item/', " + number.format("event_id") + ")",
        "status_code": "CASE WHEN event_id % 8 = 0 THEN '404' ELSE '200' END",
        "user_agent": "CASE WHEN event_id % 12 = 0 THEN '-' ELSE 'agent/1.0' END",
        "version": "'TLSv13'",
        "server_name": "CASE WHEN event_id % 14 = 0 THEN 'none' ELSE 'example.org' END",
        "note": "'Scan::Port_Scan'",
        "msg": "concat('seen ', " + number.format("event_id") + ")",
    }


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the lines of sensor logs, header lines included.

    A file per log and sensor, a block per 4096 events. From its second block on, every ssl
    log is cut by '|' and writes 'none' for unset, as its second header says. Some lines have
    a field too few or too many.
    """
    values = log_values()
    micros = F.unix_micros("ts")
    cents = F.rint(F.col("value") * 100).cast("bigint")
    base = events(spark, sf_dir).select(
        "event_id",
        "user_id",
        F.try_element_at(
            F.create_map(*[F.lit(x) for kv in LOG_OF_TYPE.items() for x in kv]),
            F.col("event_type"),
        ).alias("log"),
        F.format_string("%d.%06d", F.floor(micros / 1000000), micros % 1000000).alias(
            "epoch_text"
        ),
        F.format_string("%d.%02d", F.floor(cents / 100), cents % 100).alias("cents_text"),
        F.floor(F.col("event_id") / BLOCK_EVENTS).alias("block"),
    )
    piped = (F.col("log") == "ssl") & (F.col("block") >= 1)
    cases = []
    for log, fields in LOG_FIELDS.items():
        cells = [values[f] for f in LOG_COMMON + fields]
        cells[-1] = f"CASE WHEN event_id % 17 = 0 THEN NULL ELSE {cells[-1]} END"
        cells.append("CASE WHEN event_id % 19 = 0 THEN '' END")
        cases.append(f"WHEN '{log}' THEN concat_ws(separator, {', '.join(cells)})")
    base = base.withColumn("separator", F.when(piped, "|").otherwise("\t"))
    line = F.expr(f"CASE log {' '.join(cases)} END")
    file = F.concat("log", F.lit("-"), (F.col("user_id") % 4).cast("string"))
    data = base.select(
        file.alias("file"), "block", (F.col("event_id") * 2).alias("pos"), line.alias("value")
    )
    # One header per file, from its first event on; a second one for ssl files, behind the first
    # where the file begins with it.
    first = base.groupBy(file.alias("file"), "log").agg(F.min("block").alias("block"))
    second = base.filter(piped).groupBy(file.alias("file"), "log").agg(F.min("block").alias("block"))
    tops = _header(first, "\t", "-", 100).unionByName(_header(second, "|", "none", 50))
    lines = data.unionByName(tops).withColumn("block", F.col("block").cast("bigint"))
    # Read twice by the parser, as log files would be.
    return written(lines, "log-lines")


def _header(files: DataFrame, separator: str, unset: str, ahead: int) -> DataFrame:
    names = " ".join(
        f"WHEN '{log}' THEN '{separator.join(LOG_COMMON + fields)}'"
        for log, fields in LOG_FIELDS.items()
    )
    # With another separator than white space, the directive must still end as a word.
    directive = "#fields" + (separator if separator.isspace() else " " + separator)
    lines = [
        F.lit(f"#separator \\x{ord(separator):02x}"),
        F.lit("#set_separator ,"),
        F.lit("#empty_field (empty)"),
        F.lit(f"#unset_field {unset}"),
        F.concat(F.lit("#path "), "log"),
        F.concat(F.lit(directive), F.expr(f"CASE log {names} END")),
    ]
    top = F.posexplode(F.array(*lines)).alias("n", "value")
    # Header lines sort before the block's first event (position 2 * first event).
    return files.select("file", "block", top).select(
        "file",
        "block",
        (F.col("block") * 2 * BLOCK_EVENTS - ahead + F.col("n")).cast("bigint").alias("pos"),
        "value",
    )
