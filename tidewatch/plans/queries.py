"""Registered queries over the driver's tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import names as fnames
from tidewatch.functions import numeric, timeparse
from tidewatch.operators import buffer as rolling
from tidewatch.operators import detect as detection
from tidewatch.operators import fitting, normalize, retention, rotation, time_layout
from tidewatch.operators.flows import align_flows, check_flow_table
from tidewatch.operators.sequences import capture_lengths, scaled_states, scaled_table, sequences
from tidewatch.operators.states import (
    append_states,
    finished_states,
    load_states,
    merged_states,
    partial_states,
    state_dimensions,
    window_states,
)
from tidewatch.plans import adapters as ad
from tidewatch.plans import files
from tidewatch.plans.materialize import broadcast_if_small, written
from tidewatch.session import shared_dir
from tidewatch.sources import flow_csv, scenario_store, sinks, zeek
from tidewatch.sources.bundle import load_bundle, save_bundle
from tidewatch.streaming import buffer as stream_buffer
from tidewatch.streaming import late as stream_late
from tidewatch.streaming import logs as stream_logs
from tidewatch.streaming.windows import stream_window_states

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MINUTE, HOUR = "1 minute", "1 hour"
THRESHOLD = ad.formula_bundle().threshold
SENSOR_RETENTION = 6 * 3600


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _at(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# --- flows and states ---------------------------------------------------------------


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_flows(ad.narrow_flows(spark, sf_dir), ad.FEATURES)


@query
def flow_clean(spark, sf_dir):
    cells = [F.round(F.col(f"`{f}`"), 6).alias(f"x{i}") for i, f in enumerate(ad.FEATURES)]
    return _cleaned(spark, sf_dir).select(
        "capture_id", "event_id", _at("Timestamp").alias("at"), *cells
    )


def _rounded(features: list[str]) -> Column:
    """Three places for microsecond dimensions, six for the others."""
    spans = [
        i
        for i, n in enumerate(fnames.state_names(features))
        if any(w in n.lower() for w in ("iat", "active", "idle", "duration"))
    ]
    return F.when(F.col("dim").isin(spans), F.round("value", 3)).otherwise(F.round("value", 6))


def _state_rows(states: DataFrame, features: list[str]) -> DataFrame:
    return state_dimensions(states, features).select(
        "capture_id",
        _at("window_start").alias("window_start"),
        "flow_count",
        "feature",
        _rounded(features).alias("value"),
    )


@query
def window_state_1min(spark, sf_dir):
    return _state_rows(window_states(_cleaned(spark, sf_dir), ad.FEATURES, MINUTE), ad.FEATURES)


@query
def window_state_1h(spark, sf_dir):
    return _state_rows(window_states(_cleaned(spark, sf_dir), ad.FEATURES, HOUR), ad.FEATURES)


@query
def window_state_rollup(spark, sf_dir):
    """States of minutes, stored, merged to ten minutes and then to hours without the flows."""
    table = f"{_scratch(spark, 'states')}/minutes"
    append_states(partial_states(_cleaned(spark, sf_dir), ad.FEATURES, MINUTE), table)
    hours = merged_states(merged_states(load_states(spark, table), "10 minutes"), HOUR)
    return _state_rows(finished_states(hours), ad.FEATURES)


@query
def window_state_moments(spark, sf_dir):
    """Deviations by sums of squares; on microsecond features this form is good to whole units."""
    states = window_states(_cleaned(spark, sf_dir), ad.FEATURES, HOUR, std_mode="moments")
    long = state_dimensions(states, ad.FEATURES).filter(F.col("feature").startswith("std_"))
    spans = F.lower("feature").rlike("iat|active|idle|duration")
    return long.select(
        "capture_id",
        _at("window_start").alias("window_start"),
        "feature",
        F.when(spans, F.round("value", 0)).otherwise(F.round("value", 4)).alias("value"),
    )


@query
def window_state_wide(spark, sf_dir):
    """All 79 numeric columns of full flow records, by hour; totals over each dimension."""
    flows = align_flows(ad.wide_flows(spark, sf_dir), ad.WIDE_FEATURES)
    long = state_dimensions(window_states(flows, ad.WIDE_FEATURES, HOUR), ad.WIDE_FEATURES)
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("windows"),
        F.round(F.avg("value"), 2).alias("average"),
        F.round(F.max("value"), 2).alias("largest"),
    )


@query
def window_meta(spark, sf_dir):
    """The four meta dimensions per window."""
    long = state_dimensions(
        window_states(_cleaned(spark, sf_dir), ad.FEATURES, MINUTE), ad.FEATURES
    )
    return long.filter(F.col("feature").startswith("meta_")).select(
        "capture_id",
        _at("window_start").alias("window_start"),
        "feature",
        F.round("value", 6).alias("value"),
    )


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_states(_cleaned(spark, sf_dir), ad.FEATURES, HOUR)


@query
def signed_log_scale_clip(spark, sf_dir):
    bundle = ad.formula_bundle()
    scaled = scaled_states(_states(spark, sf_dir), bundle.scaler_mean, bundle.scaler_scale)
    return scaled.select(
        "capture_id",
        _at("window_start").alias("window_start"),
        F.posexplode("scaled").alias("dim", "value"),
    ).withColumn("value", F.round("value", 6))


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundle = ad.formula_bundle()
    return scaled_table(_states(spark, sf_dir), bundle.scaler_mean, bundle.scaler_scale)


@query
def sequence_frames(spark, sf_dir):
    """Per sequence and dimension: first, last and sum over the frame."""
    bundle = ad.formula_bundle()
    seqs = sequences(_scaled(spark, sf_dir), bundle.seq_len, bundle.window_size)

    def wide(state: Column) -> Column:
        return state.cast("array<double>")

    first, last = wide(F.element_at("seq", 1)), wide(F.element_at("seq", -1))
    zero = F.transform(first, lambda x: F.lit(0.0))
    total = F.aggregate(
        "seq", zero, lambda acc, s: F.zip_with(acc, wide(s), lambda a, b: a + b)
    )
    return seqs.select(
        "capture_id",
        "step_index",
        _at("window_start").alias("window_start"),
        F.posexplode(F.arrays_zip(first.alias("a"), last.alias("b"), total.alias("c"))).alias(
            "dim", "_x"
        ),
    ).select(
        "capture_id",
        "step_index",
        "window_start",
        "dim",
        F.round("_x.a", 4).alias("first_value"),
        F.round("_x.b", 4).alias("last_value"),
        F.round("_x.c", 4).alias("frame_sum"),
    )


@query
def capture_window_counts(spark, sf_dir):
    return capture_lengths(_states(spark, sf_dir), ad.formula_bundle().seq_len)


# --- scoring and reports ------------------------------------------------------------


def _linear_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundle = ad.formula_bundle()
    scorer = ad.formula_scorer(len(bundle.names))
    return detection.scored_windows(ad.narrow_flows(spark, sf_dir), bundle, scorer)


@query
def hybrid_risk(spark, sf_dir):
    return _linear_windows(spark, sf_dir).select(
        "capture_id",
        "step_index",
        _at("window_start").alias("window_start"),
        "timestamp",
        "flow_count",
        F.col("_debug.attack_head_prob").alias("attack_head_prob"),
        F.col("_debug.raw_mse").alias("raw_mse"),
        F.col("_debug.calibrated_mse").alias("calibrated_mse"),
        "current_risk",
        "current_stage",
    )


@query
def risk_without_baseline(spark, sf_dir):
    bundle = replace(ad.formula_bundle(), baseline=None)
    scorer = ad.formula_scorer(len(bundle.names))
    windows = detection.scored_windows(ad.narrow_flows(spark, sf_dir), bundle, scorer)
    return windows.select(
        "capture_id",
        "step_index",
        F.col("_debug.calibrated_mse").alias("calibrated_mse"),
        "current_risk",
        "current_stage",
    )


@query
def detection_log(spark, sf_dir):
    return detection.detection_log(_linear_windows(spark, sf_dir), THRESHOLD)


@query
def detection_summary(spark, sf_dir):
    return detection.detection_summary(_linear_windows(spark, sf_dir), THRESHOLD)


@query
def risk_band(spark, sf_dir):
    return detection.dashboard_rows(_linear_windows(spark, sf_dir), THRESHOLD)


@query
def forecast_points(spark, sf_dir):
    return detection.forecast_points(_linear_windows(spark, sf_dir))


@query
def top_features(spark, sf_dir):
    return _linear_windows(spark, sf_dir).select(
        "capture_id", "step_index", F.posexplode("shap_features").alias("rank", "_f")
    ).select(
        "capture_id",
        "step_index",
        "rank",
        F.col("_f.feature").alias("feature"),
        F.col("_f.importance").alias("importance"),
    )


@query
def tactic_names(spark, sf_dir):
    cls = (F.col("event_id") % 9).cast("int")
    return ad.events(spark, sf_dir).groupBy(fnames.tactic_name(cls).alias("tactic")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def state_dimension_names(spark, sf_dir):
    known = fnames.state_names(ad.FEATURES)
    index = (F.col("event_id") % (len(known) + 2)).cast("int")
    return ad.events(spark, sf_dir).groupBy(
        fnames.dimension_name(known, index).alias("feature")
    ).agg(F.count(F.lit(1)).alias("n"))


# --- fitting and evaluation ---------------------------------------------------------


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the hourly windows: more than a quarter of purchases stands for an attack."""
    start = F.window("ts", HOUR)["start"].alias("window_start")
    attack = 4 * F.count(F.when(F.col("event_type") == "purchase", 1)) > F.count(F.lit(1))
    capture = (F.col("user_id") % 4).alias("capture_id")
    return ad.events(spark, sf_dir).groupBy(capture, start).agg(attack.alias("attack"))


@query
def fit_scaler(spark, sf_dir):
    return fitting.fit_scaler(_states(spark, sf_dir)).select(
        "dim", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale")
    )


@query
def fit_benign_baseline(spark, sf_dir):
    bundle = ad.formula_bundle()
    seqs = sequences(_scaled(spark, sf_dir), bundle.seq_len, bundle.window_size)
    errors = fitting.reconstruction_errors(seqs, bundle, ad.formula_scorer(len(bundle.names)))
    marked = errors.join(_marks(spark, sf_dir), ["capture_id", "window_start"])
    return fitting.fit_benign_baseline(marked, ~F.col("attack")).select(
        F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "windows"
    )


@query
def eval_binary(spark, sf_dir):
    marked = _linear_windows(spark, sf_dir).join(
        _marks(spark, sf_dir), ["capture_id", "window_start"]
    )
    found = fitting.eval_binary(marked, F.col("current_risk") >= THRESHOLD, F.col("attack"))
    measures = ("precision", "recall", "f1", "false_positive_rate")
    return found.select("tp", "fp", "fn", "tn", *[F.round(m, 6).alias(m) for m in measures])


@query
def fitted_detection(spark, sf_dir):
    """Detection with a bundle whose scaling and baseline are fitted on the same flows."""
    plain = ad.formula_bundle()
    scorer = ad.formula_scorer(len(plain.names))
    bundle = fitting.fitted_bundle(
        _states(spark, sf_dir), _marks(spark, sf_dir), ["capture_id"], plain, scorer
    )
    windows = detection.scored_windows(ad.narrow_flows(spark, sf_dir), bundle, scorer)
    return detection.detection_summary(windows, bundle.threshold)


# --- scenario store -----------------------------------------------------------------


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """Detections of all captures in a store; one of them is saved a second time."""
    store = _scratch(spark, "scenarios")
    bundle = ad.formula_bundle()
    flows = ad.narrow_flows(spark, sf_dir)
    found = detection.detect(flows, bundle, ad.formula_scorer(len(bundle.names)))
    name = F.concat(F.lit("capture_0"), F.col("capture_id").cast("string"))
    meta = found.metadata.withColumn("scenario_id", name).drop("capture_id")
    windows = found.windows.withColumn("scenario_id", name).drop("capture_id")
    scenario_store.save_scenarios(meta, windows, store)
    again = F.col("scenario_id") == "capture_01"
    scenario_store.save_scenarios(
        meta.filter(again).withColumn("name", F.lit("Replaced")), windows.filter(again), store
    )
    return store


@query
def scenario_list(spark, sf_dir):
    return scenario_store.list_scenarios(spark, _stored(spark, sf_dir))


@query
def scenario_metadata(spark, sf_dir):
    meta = scenario_store.load_table(spark, _stored(spark, sf_dir), "scenario_meta")
    return meta.select(
        "scenario_id",
        "total_windows",
        "rows_ingested",
        "attack_windows_detected",
        F.concat_ws(",", "detected_features").alias("detected_features"),
    )


@query
def scenario_step(spark, sf_dir):
    found = scenario_store.scenario_step(spark, _stored(spark, sf_dir), "capture_02", 3)
    return found.select(
        "scenario_id", "target_asset", "step_index", "total_steps", "timestamp", "current_risk"
    )


@query
def scenario_windows(spark, sf_dir):
    store = _stored(spark, sf_dir)
    both = scenario_store.steps_with_metadata(
        scenario_store.load_table(spark, store, "scenario_meta"),
        scenario_store.load_table(spark, store, "scenario_windows"),
    )
    return both.select("scenario_id", "name", "step_index", "current_risk", "total_windows")


# --- rolling buffer -----------------------------------------------------------------


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = ad.buffer_flows(spark, sf_dir)
    rows = rolling.buffer_rows(
        flows.drop("user_id"), seq=ad.shuffled_arrival(), sensor=F.lit("all")
    )
    return rows


def _sensor_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sensor = F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string"))
    return rolling.buffer_rows(
        ad.buffer_flows(spark, sf_dir), seq=ad.jittered_arrival(), sensor=sensor
    )


@query
def epoch_parse(spark, sf_dir):
    flows = ad.buffer_flows(spark, sf_dir)
    return flows.select(
        "event_id", timeparse.buffer_epoch(F.col("timestamp")).alias("ts_epoch")
    )


@query
def rolling_buffer(spark, sf_dir):
    return rolling.survivors(_arrivals(spark, sf_dir)).select("arrival_seq", "_id", "ts_epoch")


@query
def rolling_buffer_sensors(spark, sf_dir):
    kept = rolling.survivors(_sensor_arrivals(spark, sf_dir), SENSOR_RETENTION)
    return kept.select("sensor", "arrival_seq", "_id", "ts_epoch")


@query
def rolling_buffer_reinserted(spark, sf_dir):
    """Flows arrive a second time, later and under their own id: the last insert counts."""
    rows = _sensor_arrivals(spark, sf_dir)
    again = rows.filter("arrival_seq % 3 = 0").withColumns(
        {
            "arrival_seq": F.col("arrival_seq") + (1 << 44),
            "ts_epoch": F.col("ts_epoch") - 60,
        }
    )
    kept = rolling.survivors(rows.unionByName(again), SENSOR_RETENTION, supplied_ids=True)
    return kept.select("sensor", "arrival_seq", "_id", "ts_epoch")


@query
def buffer_sizes(spark, sf_dir):
    """Flows each sensor's buffer holds after every single insert."""
    return rolling.sizes_after_inserts(_sensor_arrivals(spark, sf_dir), SENSOR_RETENTION).select(
        "sensor", "arrival_seq", "flow_count"
    )


RANGE = (1704844800.0, 1705449600.0)  # 2024-01-10 to 2024-01-17


@query
def buffer_range(spark, sf_dir):
    schema = "timestamp string, src_ip string, dst_port bigint, _id string"
    flows = rolling.read_flows(_arrivals(spark, sf_dir), schema, *RANGE)
    return flows.select("ts_epoch", "_id", "src_ip", "dst_port")


def _laid_out(spark: SparkSession, sf_dir: str) -> str:
    table = _scratch(spark, "buffer-by-time")
    time_layout.write_by_time(_arrivals(spark, sf_dir), table, 16)
    return table


@query
def buffer_range_by_zones(spark, sf_dir):
    """The range of buffer_range, from the files whose times meet it."""
    rows = time_layout.rows_between(spark, _laid_out(spark, sf_dir), *RANGE)
    schema = "timestamp string, src_ip string, dst_port bigint, _id string"
    return rolling.read_flows(rows, schema).select("ts_epoch", "_id", "src_ip", "dst_port")


@query
def buffer_ends_by_zones(spark, sf_dir):
    """The seven oldest and the seven newest flows, from the files at either end."""
    table = _laid_out(spark, sf_dir)
    ends = {"oldest": time_layout.oldest_of(spark, table, 7), "newest": time_layout.newest_of(spark, table, 7)}
    found = [rows.select(F.lit(name).alias("end"), "ts_epoch") for name, rows in ends.items()]
    return found[0].unionByName(found[1])


@query
def buffer_prune(spark, sf_dir):
    kept, removed = rolling.prune(_arrivals(spark, sf_dir), RANGE[1], 7 * 86400)
    left = kept.agg(F.count(F.lit(1)).alias("flows")).withColumn("state", F.lit("kept"))
    gone = removed.select(F.col("removed").alias("flows"), F.lit("removed").alias("state"))
    return left.unionByName(gone)


@query
def buffer_stats(spark, sf_dir):
    rows = rolling.survivors(_sensor_arrivals(spark, sf_dir), SENSOR_RETENTION)
    return rolling.buffer_stats(rows)


@query
def buffer_oldest5(spark, sf_dir):
    rows = rolling.survivors(_sensor_arrivals(spark, sf_dir), SENSOR_RETENTION)
    return rolling.oldest(rows).select("ts_epoch", "_id")


@query
def buffer_newest5(spark, sf_dir):
    rows = rolling.survivors(_sensor_arrivals(spark, sf_dir), SENSOR_RETENTION)
    return rolling.newest(rows).select("ts_epoch", "_id")


@query
def flow_summary(spark, sf_dir):
    rows = _arrivals(spark, sf_dir)
    return rolling.listing(rows).select("ts_epoch", "at", "flow")


# --- sensor logs --------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zeek.parse_log(ad.log_lines(spark, sf_dir))


@query
def zeek_parse(spark, sf_dir):
    return _records(spark, sf_dir).select(
        "file", "pos", "path", F.explode("rec").alias("field", "value")
    )


@query
def zeek_rejects(spark, sf_dir):
    return zeek.reject_counts(ad.log_lines(spark, sf_dir))


@query
def zeek_conn(spark, sf_dir):
    return normalize.connection_events(_records(spark, sf_dir))


@query
def zeek_dns(spark, sf_dir):
    return normalize.dns_events(_records(spark, sf_dir))


@query
def zeek_http(spark, sf_dir):
    return normalize.http_events(_records(spark, sf_dir))


@query
def zeek_generic(spark, sf_dir):
    rest = normalize.other_events(_records(spark, sf_dir))
    return rest.select(
        "timestamp",
        "event_type",
        "src_ip",
        "src_port",
        "dst_ip",
        "dst_port",
        F.explode("extra").alias("field", "value"),
    )


def _event_rows(text: DataFrame) -> DataFrame:
    parsed = F.from_json(
        "value",
        "timestamp string, event_type string, src_ip string, src_port int, duration double, "
        "status_code int, query string, server_name string, msg string",
    )
    return text.select(parsed.alias("e")).select("e.*")


@query
def event_sink(spark, sf_dir):
    """Events of all logs, written as rotated JSON lines and read back."""
    folder = _scratch(spark, "event-sink")
    sinks.write_events(normalize.all_events(_records(spark, sf_dir)), folder)
    return _event_rows(spark.read.option("recursiveFileLookup", "true").text(folder))


#: Lines of one rotated log file, to which its last block may add.
LINES_PER_FILE = 50_000


def _write_logs(lines: DataFrame, folder: str) -> None:
    """Log files of lines with their parts: one for each file and part."""
    whole = lines.withColumnRenamed("file", "log")
    ordered = whole.repartition("log", "part").sortWithinPartitions("log", "part", "block", "pos")
    ordered.select("log", "part", "value").write.partitionBy("log", "part").text(folder)


def _rotated(lines: DataFrame, turns: int = 1, per_file: int = LINES_PER_FILE) -> DataFrame:
    """Lines of logs and the rotated file (``turn``, ``part``) of each.

    Blocks go to the turns one after another. A part is made of whole blocks until it has
    ``per_file`` lines, so the number of files grows with the lines, however few a block has.
    Each part is led by the header that holds for it, and a header that comes into force later
    stands where it does, so that every rotated file can be read on its own.
    """
    is_head = F.col("value").startswith("#")
    heads = lines.filter(is_head).withColumnRenamed("block", "head")
    body = lines.filter(~is_head)
    before = Window.partitionBy("file", "turn").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = body.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("turn", F.pmod("block", F.lit(turns)))
    part = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / per_file).cast("string")
    parts = written(sizes.select("file", "block", "turn", part.alias("part")), "log-parts")
    holds = (
        parts.join(heads.select("file", "head").distinct(), "file").filter("head <= block")
        .groupBy("file", "turn", "part", "block").agg(F.max("head").alias("head"))
        .groupBy("file", "turn", "part", "head").agg(F.min("block").alias("block"))
    )
    # A block without a file or a number has a part, too.
    of = broadcast_if_small(parts.withColumnsRenamed({"file": "_file", "block": "_block"}))
    same = F.col("file").eqNullSafe(F.col("_file")) & F.col("block").eqNullSafe(F.col("_block"))
    rows = body.join(of, same).drop("_file", "_block")
    return rows.unionByName(holds.join(heads, ["file", "head"]).select(rows.columns))


@query
def log_file_scan(spark, sf_dir):
    """Logs written as text files and scanned as such, with header and body in one file."""
    folder = _scratch(spark, "logs")
    _write_logs(_rotated(ad.log_lines(spark, sf_dir)), folder)
    text = spark.read.option("recursiveFileLookup", "true").text(folder)
    records = zeek.parse_log(zeek.positioned(text))
    return normalize.all_events(records).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.count("src_port").alias("with_port"),
        F.sum(F.col("orig_bytes")).alias("orig_bytes"),
    )


@query
def log_times(spark, sf_dir):
    micros = F.unix_micros("ts")
    epoch = F.format_string("%d.%06d", F.floor(micros / 1000000), micros % 1000000)
    text = F.when(F.col("event_id") % 23 == 0, F.lit("no-time")).otherwise(epoch)
    return ad.events(spark, sf_dir).select("event_id", timeparse.log_time(text).alias("timestamp"))


@query
def safe_numbers(spark, sf_dir):
    """Number texts of every accepted and refused spelling."""
    spellings = ["' 12 '", "'12.0'", "'1e3'", "''", "'-'", "'1.5d'", "'1.5f'", "'-7'", "'abc'"]
    text = F.get(F.array(*[F.expr(s) for s in spellings]), (F.col("event_id") % 9).cast("int"))
    return ad.events(spark, sf_dir).select(
        "event_id",
        numeric.safe_int(text).alias("whole"),
        numeric.safe_float(text).alias("real"),
    )


# --- slots, names, fields, files ----------------------------------------------------


@query
def buffer_append_batches(spark, sf_dir):
    """Events put into a buffer table in three batches without ids or order of their own."""
    table = f"{_scratch(spark, 'buffer-batches')}/buffer"
    flows = ad.events(spark, sf_dir).select("event_id", F.unix_micros("ts").alias("micros"))
    for batch in range(3):
        part = flows.filter(F.col("event_id") % 3 == batch).orderBy("event_id")
        rolling.append_flows(part.select("event_id", (F.col("micros") / F.lit(1e6)).alias("timestamp")), table)
    kept = rolling.survivors(rolling.load_buffer(spark, table), SENSOR_RETENTION)
    at = F.get_json_object("payload", "$.event_id").cast("bigint")
    return kept.select(at.alias("event_id"))


@query
def slot_keys(spark, sf_dir):
    ts = F.col("ts")
    return ad.events(spark, sf_dir).select(
        "event_id",
        rotation.slot_date(ts).alias("slot_date"),
        rotation.slot_key(ts, 15).alias("slot_15"),
        rotation.slot_key(ts, 25).alias("slot_25"),
        rotation.flow_file_name(ts, 5).alias("file_name"),
    )


@query
def next_slot_seconds(spark, sf_dir):
    ts = F.col("ts")
    return ad.events(spark, sf_dir).select(
        "event_id",
        rotation.seconds_to_next_slot(ts, 1).alias("left_1"),
        rotation.seconds_to_next_slot(ts, 5).alias("left_5"),
        rotation.seconds_to_next_slot(ts, 25).alias("left_25"),
    )


@query
def normalize_names(spark, sf_dir):
    part = ad.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    customer = ad.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    both = part.unionByName(customer)
    return both.groupBy(fnames.match_name_col(F.col("name")).alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def flow_fields(spark, sf_dir):
    """Chosen columns only, through the archive and back."""
    folder = _scratch(spark, "archive")
    flows = ad.narrow_flows(spark, sf_dir).withColumn("timestamp", _at("timestamp"))
    sinks.write_flow_archive(flows, folder, "event_id,timestamp,dst_port")
    read = spark.read.option("recursiveFileLookup", "true").csv(
        folder, header=True, schema="event_id bigint, timestamp string, dst_port bigint"
    )
    return read


def _flow_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Two captures as CSV files; the second lacks a column."""
    flows = ad.narrow_flows(spark, sf_dir).withColumn("timestamp", _at("timestamp"))
    flows = flows.withColumn("flow_duration", F.round(F.col("flow_duration") * 100).cast("bigint"))
    first = flows.filter("capture_id % 2 = 0")
    second = flows.filter("capture_id % 2 = 1").drop("cwr_flag_count")
    first.drop("capture_id").write.csv(f"{folder}/a", header=True)
    second.drop("capture_id").write.csv(f"{folder}/b", header=True)


@query
def flow_csv_scan(spark, sf_dir):
    folder = _scratch(spark, "flow-csv")
    _flow_files(spark, sf_dir, folder)
    flows = flow_csv.read_flows(spark, folder=folder, merge=True).drop("capture_id")
    aligned = align_flows(flows, ad.FEATURES)
    return aligned.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        _at("Timestamp").alias("at"),
        F.round("Flow Duration", 3).alias("duration"),
        F.round("Tot Fwd Pkts", 3).alias("packets"),
    )


@query
def flow_csv_orders(spark, sf_dir):
    """Files of one folder whose columns stand in three different orders."""
    folder = _scratch(spark, "flow-csv")
    flows = ad.narrow_flows(spark, sf_dir).withColumn("timestamp", _at("timestamp"))
    flows = flows.withColumn("flow_duration", F.round(F.col("flow_duration") * 100).cast("bigint"))
    names = sorted(c for c in flows.columns if c != "capture_id")
    for i, order in enumerate((names, names[::-1], names[3:] + names[:3])):
        flows.filter(F.col("event_id") % 3 == i).select(*order).write.mode("append").csv(folder, header=True)
    aligned = align_flows(flow_csv.read_flow_csv(spark, folder).drop("capture_id"), ad.FEATURES)
    return aligned.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        _at("Timestamp").alias("at"),
        F.col("Dst Port").cast("bigint").alias("dst_port"),
        F.round("Flow Duration", 3).alias("duration"),
        F.round("Tot Fwd Pkts", 3).alias("packets"),
    )


@query
def flow_csv_merge(spark, sf_dir):
    folder = _scratch(spark, "flow-csv")
    _flow_files(spark, sf_dir, folder)
    merged = flow_csv.read_flows(spark, folder=folder, merge=True)
    return merged.agg(
        F.count(F.lit(1)).alias("flows"),
        F.count("cwr_flag_count").alias("with_cwr"),
        F.sum(F.col("dst_port").cast("bigint")).alias("ports"),
    )


@query
def flow_csv_captures(spark, sf_dir):
    """Captures of three unlike headers in one read, kept as one output each and read back."""
    folder, kept = _scratch(spark, "flow-csv"), _scratch(spark, "captures")
    flows = ad.narrow_flows(spark, sf_dir).drop("capture_id").withColumn("timestamp", _at("timestamp"))
    unlike = (
        flows,
        flows.drop("cwr_flag_count"),
        flows.select(*flows.columns[::-1], F.lit("x, y").alias("Label")).withColumnRenamed("dst_port", "Dst Port"),
    )
    for i, part in enumerate(unlike):
        part.filter(F.col("event_id") % 3 == i).write.csv(f"{folder}/{i}", header=True)
    sinks.store_capture_rows(flow_csv.read_capture_rows(spark, folder), kept)
    port = F.coalesce(flow_csv.captured("dst_port", "bigint"), flow_csv.captured("Dst Port", "bigint"))
    return spark.read.parquet(kept).select(
        flow_csv.captured("event_id", "bigint").alias("event_id"),
        port.alias("dst_port"),
        flow_csv.captured("cwr_flag_count", "bigint").alias("cwr"),
        flow_csv.captured("Label").alias("label"),
        F.size(F.json_object_keys(F.to_json("flow"))).alias("cells"),
    )


RETAINED_TO = 1705449600.0  # 2024-01-17


def _slotted_events(spark: SparkSession, sf_dir: str) -> str:
    """Event files where each event went to the hour of its time."""
    folder = _scratch(spark, "retention")
    text = ad.events(spark, sf_dir).select("ts", F.to_json(F.struct("event_id")).alias("json"))
    sinks.write_events(text.repartitionByRange("ts"), folder, 60, at=F.col("ts"))
    return folder


@query
def retention_report(spark, sf_dir):
    """Slots past a limit that lies within the data, by date."""
    folder = _slotted_events(spark, sf_dir)
    gone = retention.expired_slots(spark, folder, 10, RETAINED_TO, 60)
    return gone.groupBy(F.date_format("begins", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("slots"))


@query
def retention_clean(spark, sf_dir):
    """Events left, and folders gone, once expired slots are deleted; the slot that the limit
    falls into has new files only and stays."""
    folder = _slotted_events(spark, sf_dir)
    before = retention.slots_of(spark, folder, 60).count()
    removed = retention.clean_slots(spark, folder, 10, RETAINED_TO, 60)
    left = retention.slots_of(spark, folder, 60)
    text = spark.read.option("recursiveFileLookup", "true").text(folder)
    return text.agg(
        F.count(F.lit(1)).alias("events"),
        F.min(F.get_json_object("value", "$.event_id").cast("bigint")).alias("first_event"),
    ).crossJoin(
        left.agg((F.lit(before) - F.count(F.lit(1))).alias("slots_gone"), F.lit(removed >= 1).alias("counted"))
    )


@query
def expired_event_files(spark, sf_dir):
    """Event files by their own time: all are younger than an hour, none than the year 2100."""
    folder = _slotted_events(spark, sf_dir)
    day = F.regexp_extract("path", "date=([0-9-]+)", 1).alias("day")
    hour = F.regexp_extract("path", "slot=([0-9]+)-", 1)
    found = [
        retention.expired_files(spark, folder, 60, now).select(F.lit(label).alias("at"), day, hour.alias("hour"))
        for label, now in (("now", None), ("2100", 4102444800.0))
    ]
    return found[0].unionByName(found[1]).groupBy("at", "day").agg(F.countDistinct("hour").alias("slots"))


@query
def flow_times_dropped(spark, sf_dir):
    """Flows whose time cannot be read are left out; every capture's count before and after."""
    text = F.when(F.col("event_id") % 23 == 0, "no time").when(F.col("event_id") % 29 != 0, _at("timestamp"))
    flows = ad.narrow_flows(spark, sf_dir).withColumn("timestamp", text)
    kept = align_flows(flows, ad.FEATURES).groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("event_id").alias("ids")
    )
    read = flows.groupBy("capture_id").agg(F.count(F.lit(1)).alias("read"))
    return read.join(kept, "capture_id")


@query
def flow_table_checks(spark, sf_dir):
    """Quality checks of full flow records, of narrow ones and of a table without rows."""
    wide = ad.wide_flows(spark, sf_dir).drop("capture_id")
    tables = {"wide": wide, "narrow": ad.narrow_flows(spark, sf_dir), "empty": wide.limit(0)}
    found = [check_flow_table(t).select(F.lit(name).alias("flows"), "check", "passed") for name, t in tables.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def buffer_cleared(spark, sf_dir):
    """Flows in a buffer table when filled, after it is cleared, and when it is used again."""
    table = f"{_scratch(spark, 'buffer-clear')}/buffer"
    rows = _sensor_arrivals(spark, sf_dir)
    rolling.append_buffer(rows, table)
    filled = rolling.load_buffer(spark, table).count()
    rolling.clear_buffer(spark, table)
    cleared = rolling.load_buffer(spark, table).count()
    rolling.append_buffer(rows.filter("arrival_seq % 2 = 0"), table)
    again = rolling.load_buffer(spark, table).agg(F.count(F.lit(1)).alias("again"))
    return again.select(F.lit(filled).cast("bigint").alias("filled"), F.lit(cleared).cast("bigint").alias("cleared"), "again")


@query
def bundle_stored(spark, sf_dir):
    """Scaling fitted on hourly states, stored in a bundle and read back from it."""
    plain = ad.formula_bundle()
    fitted = fitting.fit_scaler(_states(spark, sf_dir)).orderBy("dim").collect()  # one row a dimension
    bundle = replace(plain, scaler_mean=[r["mean"] for r in fitted], scaler_scale=[r["scale"] for r in fitted])
    folder = _scratch(spark, "bundle")
    save_bundle(bundle, folder, spark)
    again = load_bundle(folder, spark)
    rows = [(i, float(m), float(s)) for i, (m, s) in enumerate(zip(again.scaler_mean, again.scaler_scale))]
    table = spark.createDataFrame(rows, "dim int, mean double, scale double")
    return table.select("dim", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query
def log_fan_in(spark, sf_dir):
    """All logs of a folder in one read by their names: current and rotated ones of the five
    known logs, compressed or not, and no others."""
    folder = _scratch(spark, "fan-in")
    lines = ad.log_lines(spark, sf_dir)
    ordered = lines.withColumnRenamed("file", "log").repartition("log").sortWithinPartitions("log", "block", "pos")
    ordered.select("log", "value").write.partitionBy("log").text(f"{folder}/written")
    # Under the names that sensors give: the first of a kind current, the second for another
    # tool, the others rotated.
    for path, is_folder in list(files.children(spark, f"{folder}/written")):
        if is_folder and "log=" in path:
            kind, sensor = path.rsplit("log=", 1)[1].split("-")
            part = next(p for p, _ in files.children(spark, path) if p.rsplit("/", 1)[-1].startswith("part-"))
            name = {"0": f"{kind}.log", "1": f"other-{kind}.log"}.get(sensor, f"{kind}.day-{sensor}.log")
            files.make_folder(spark, f"{folder}/logs/sensor-{sensor}")
            files.rename(spark, part, f"{folder}/logs/sensor-{sensor}/{name}")
    found = zeek.parse_log(zeek.read_log_lines(spark, f"{folder}/logs"))
    name = F.regexp_extract("file", "([^/]+)$", 1)
    return found.groupBy(name.alias("file"), "path").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.size(F.map_keys("rec"))).alias("cells")
    )


# --- streams ------------------------------------------------------------------------


@query
def stream_window_state(spark, sf_dir):
    """Hourly states from a stream. A closing row of a later day, in a second run, ends the last
    window; its own stays open and is not emitted."""
    ad.configure(spark)
    base = _scratch(spark, "stream-states")
    flows = ad.narrow_flows(spark, sf_dir)
    flows.repartitionByRange(4, "timestamp").write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    last = flows.orderBy(F.col("timestamp").desc()).limit(1)
    for closing in (None, last):
        if closing is not None:
            later = F.col("timestamp") + F.expr("INTERVAL 2 DAYS")
            closing.withColumn("timestamp", later).write.mode("append").parquet(f"{base}/in")
        read = spark.readStream.schema(schema).parquet(f"{base}/in")
        states = stream_window_states(align_flows(read, ad.FEATURES), ad.FEATURES, HOUR)
        run = (
            states.writeStream.format("parquet")
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    return _state_rows(spark.read.parquet(f"{base}/out"), ad.FEATURES)


def _dual_sink(spark: SparkSession, sf_dir: str) -> str:
    """Flows streamed into an archive and a buffer; the folder that holds both.

    The later half arrives after the stream has stopped once and is picked up on restart.
    """
    base = _scratch(spark, "stream-buffer")
    flows = ad.buffer_flows(spark, sf_dir).withColumn("arrival", ad.jittered_arrival())
    middle = flows.agg((F.max("arrival") / 2).alias("middle")).first()["middle"]

    def to_rows(batch: DataFrame) -> DataFrame:
        sensor = F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string"))
        return rolling.buffer_rows(batch, seq=F.col("arrival"), sensor=sensor)

    for half in (F.col("arrival") <= middle, F.col("arrival") > middle):
        flows.filter(half).write.mode("append").parquet(f"{base}/in")
        stream_buffer.start_dual_sink(
            spark.readStream.schema(flows.schema).parquet(f"{base}/in"),
            f"{base}/archive",
            f"{base}/buffer",
            f"{base}/checkpoint",
            available_now=True,
            to_rows=to_rows,
            retention=SENSOR_RETENTION,
        ).awaitTermination()
    return base


@query
def stream_rolling_buffer(spark, sf_dir):
    kept = stream_buffer.read_buffer(spark, f"{_dual_sink(spark, sf_dir)}/buffer", SENSOR_RETENTION)
    return kept.select("sensor", "arrival_seq", "_id", "ts_epoch")


@query
def stream_default_rows(spark, sf_dir):
    """Flows without ids or order of their own, in four micro-batches of a stream."""
    base = _scratch(spark, "stream-default")
    flows = ad.events(spark, sf_dir).select("event_id", (F.unix_micros("ts") / F.lit(1e6)).alias("timestamp"))
    for batch in range(4):
        part = flows.filter(F.col("event_id") % 4 == batch).repartitionByRange(1, "event_id")
        part.sortWithinPartitions("event_id").write.mode("append").parquet(f"{base}/in")
        stream_buffer.start_dual_sink(
            spark.readStream.schema(flows.schema).parquet(f"{base}/in"),
            f"{base}/archive", f"{base}/buffer", f"{base}/checkpoint", available_now=True,
            retention=SENSOR_RETENTION,
        ).awaitTermination()
    kept = stream_buffer.read_buffer(spark, f"{base}/buffer", SENSOR_RETENTION)
    at = F.get_json_object("payload", "$.event_id").cast("bigint")
    return kept.select(at.alias("event_id"), "ts_epoch")


@query
def stream_flow_archive(spark, sf_dir):
    """The archive keeps every flow, also those the buffer has dropped."""
    folder = f"{_dual_sink(spark, sf_dir)}/archive"
    return (
        spark.read.option("recursiveFileLookup", "true")
        .csv(folder, header=True)
        .select("_id", "timestamp", F.col("dst_port").cast("bigint").alias("dst_port"))
    )


@query
def stream_unique_ids(spark, sf_dir):
    """Every flow is delivered twice; the second delivery is dropped by its id."""
    base = _scratch(spark, "stream-ids")
    flows = ad.events(spark, sf_dir).select(
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("_id"), "ts"
    )
    for _ in range(2):
        flows.write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(flows.schema).parquet(f"{base}/in")
    run = (
        stream_buffer.without_replays(stream, "ts", "60 days")
        .writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("_id", _at("ts").alias("at"))


@query
def stream_event_log(spark, sf_dir):
    """Log files streamed into rotated events, read back."""
    base = _scratch(spark, "stream-logs")
    _write_logs(_rotated(ad.log_lines(spark, sf_dir)), f"{base}/in")
    lines = stream_logs.log_stream(spark, f"{base}/in", "*.txt")
    stream_logs.start_log_stream(
        lines, f"{base}/out", f"{base}/checkpoint", available_now=True
    ).awaitTermination()
    text = spark.read.option("recursiveFileLookup", "true").text(f"{base}/out")
    return _event_rows(text)


@query
def stream_event_counts(spark, sf_dir):
    """Events written by a stream of log files that was stopped once, as its batches counted."""
    base = _scratch(spark, "stream-counts")
    lines = _rotated(ad.log_lines(spark, sf_dir), turns=2)
    for turn in (0, 1):
        _write_logs(lines.filter(F.col("turn") == turn), f"{base}/in/{turn}")
        stream_logs.start_log_stream(
            stream_logs.log_stream(spark, f"{base}/in", "*.txt"),
            f"{base}/out", f"{base}/checkpoint", available_now=True, counts=f"{base}/counts",
        ).awaitTermination()
    return stream_logs.event_count(spark, f"{base}/counts").select("events")


@query
def stream_late_rows(spark, sf_dir):
    """Two thirds of the flows arrive first; of the others those are late whose hour had
    closed by then."""
    base = _scratch(spark, "stream-late")
    flows = ad.narrow_flows(spark, sf_dir).select("event_id", "timestamp")
    schema = flows.schema
    for part in (F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 0):
        flows.filter(part).write.mode("append").parquet(f"{base}/in")
        read = spark.readStream.schema(schema).parquet(f"{base}/in")
        stream_late.start_late_split(
            read, f"{base}/split", f"{base}/checkpoint", available_now=True,
            window_size=HOUR, delay="90 minutes", time_column="timestamp",
        ).awaitTermination()
    late = stream_late.read_late(spark, f"{base}/split", schema)
    counts = stream_late.late_counts(spark, f"{base}/split").select("rows", "late_rows")
    return late.select("event_id", _at("timestamp").alias("at")).join(F.broadcast(counts))
