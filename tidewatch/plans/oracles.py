"""The registered queries as ANSI SQL, written from the definitions for the checker."""

from __future__ import annotations

from tidewatch.functions.names import horizon_labels, state_names
from tidewatch.plans import adapters as ad
from tidewatch.plans.queries import RANGE, RETAINED_TO, SENSOR_RETENTION, THRESHOLD
from tidewatch.schemas import EVENT_BODY, TACTIC_NAMES, VERDICT_ATTACK, VERDICT_CLEAR

BUNDLE = ad.formula_bundle()
NAMES = BUNDLE.names
WIDTH = len(NAMES)
N = len(ad.FEATURES)


def _d(x: float) -> str:
    """Double literal: a bare 0.1 would be a decimal."""
    return f"CAST({x!r} AS DOUBLE)"


def _text(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


PROTOCOL = """CASE WHEN event_type IN ('view', 'click') THEN 6 WHEN event_type = 'purchase' THEN 17
 WHEN event_type = 'signup' THEN 1 ELSE 0 END"""
PORT = "((user_id * 7919 + event_id) % 65536)"
AT = "strftime({}, '%Y-%m-%d %H:%M:%S')"

# Cleaned flows: x0.. are the features in order.
CLEAN = f"""raw AS (SELECT user_id % 4 AS capture_id, event_id, ts,
  CAST({PORT} AS DOUBLE) AS x0, CAST({PROTOCOL} AS DOUBLE) AS x1, value * {_d(1e6)} AS x2,
  try_cast(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS r3,
  CASE WHEN event_id % 97 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 89 = 0
   THEN try_cast('bad' AS DOUBLE) ELSE value / 10 END * {_d(1e6)} AS r4,
  CAST(event_id % 3 AS DOUBLE) AS x5 FROM events),
flows AS (SELECT capture_id, event_id, ts, x0, x1, x2, coalesce(r3, 0) AS x3,
  CASE WHEN r4 IS NULL OR isinf(r4) OR isnan(r4) THEN 0 ELSE r4 END AS x4, x5,
  CAST(0 AS DOUBLE) AS x6 FROM raw)"""


def _cells(expr: str, width: int = N) -> str:
    return ", ".join(expr.format(f"x{i}") for i in range(width))


STDDEV = "stddev_pop({0})"
META = """ln(1 + CAST(count(*) AS DOUBLE)), ln(1 + CAST(count(DISTINCT x0) AS DOUBLE)),
 CAST(count(DISTINCT x1) AS DOUBLE), avg(CASE WHEN x0 > 1024 THEN CAST(1 AS DOUBLE) ELSE 0 END)"""


def _states(unit: str) -> str:
    return f"""{CLEAN}, states AS (SELECT capture_id, date_trunc('{unit}', ts) AS w,
  count(*) AS flow_count, [{_cells('avg({0})')}, {_cells(STDDEV)}, {_cells('min({0})')},
  {_cells('max({0})')}, {META}] AS state FROM flows GROUP BY 1, 2),
long AS (SELECT capture_id, w, flow_count, unnest(range({WIDTH})) AS dim, unnest(state) AS v
  FROM states)"""


def _spans(names) -> str:
    words = ("iat", "active", "idle", "duration")
    picked = [str(i) for i, n in enumerate(names) if any(x in n.lower() for x in words)]
    return ", ".join(picked)


def _state_rows(unit: str) -> str:
    return f"""WITH {_states(unit)} SELECT capture_id, {AT.format('w')} AS window_start,
  flow_count, {_text(NAMES)}[dim + 1] AS feature,
  CASE WHEN dim IN ({_spans(NAMES)}) THEN round(v, 3) ELSE round(v, 6) END AS value FROM long"""


# Scaled states, then one row per window and dimension that has seq_len windows before it.
SCALED = f"""{_states('hour')}, scaled AS (SELECT *, greatest({_d(-3.0)}, least({_d(3.0)},
  (sign(v) * ln(1 + abs(v)) - ({_d(1.0)} + {_d(1.5)} * (dim % 7)))
   / ({_d(2.0)} + {_d(0.5)} * (dim % 5)))) AS s FROM long)"""
LENGTH = BUNDLE.seq_len
def _framed(scaled: str) -> str:
    return f"""{scaled}, framed AS (SELECT *, CAST(CAST(s AS FLOAT) AS DOUBLE) AS f,
  row_number() OVER (PARTITION BY capture_id, dim ORDER BY w) - 1 - {LENGTH} AS step_index
  FROM scaled), seqs AS (SELECT *,
  first_value(f) OVER back AS fa, lag(f) OVER byw AS fz, sum(f) OVER back AS fs
  FROM framed WINDOW byw AS (PARTITION BY capture_id, dim ORDER BY w),
  back AS (PARTITION BY capture_id, dim ORDER BY w ROWS BETWEEN {LENGTH} PRECEDING AND 1 PRECEDING)
  QUALIFY step_index >= 0)"""


FRAME = _framed(SCALED)


def _pick(values) -> str:
    """Formula table as a list indexed by the dimension."""
    return "[" + ", ".join(_d(v) for v in values) + "][dim + 1]"


ATTACK = _pick([ad.attack_weight(d) for d in range(WIDTH)])


def _ahead(steps: int) -> str:
    factor, added = 1.0, 0.0
    for _ in range(steps):
        factor, added = factor * ad.LINEAR_DECAY, added * ad.LINEAR_DECAY + ad.LINEAR_DRIFT
    return f"(fz * {_d(factor)} + {_d(added)})" if steps else "fz"


def _argmax(columns) -> str:
    best = f"greatest({', '.join(columns)})"
    cases = " ".join(f"WHEN {c} = {best} THEN {i}" for i, c in enumerate(columns))
    return f"CASE {cases} END"


def _stage(cls: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in TACTIC_NAMES.items())
    return f"CASE {cls} {cases} ELSE 'Unknown' END"


def _scored(frame: str = FRAME, between: str = "", baseline: tuple[str, str] | None = None) -> str:
    """between: tables over the sums, such as a baseline that is fitted on them."""
    sums = []
    for k in range(BUNDLE.k_steps):
        state = _ahead(k)
        sums.append(f"sum({state} * {ATTACK}) + {_d(ad.LINEAR_BIAS)} AS l{k}")
        for c in range(ad.CLASS_COUNT):
            weights = _pick([ad.class_weight(c, d) for d in range(WIDTH)])
            sums.append(f"sum({state} * {weights}) AS c{k}_{c}")
    picks = [
        _argmax([f"c{k}_{c}" for c in range(ad.CLASS_COUNT)]) + f" AS m{k}"
        for k in range(BUNDLE.k_steps)
    ]
    probs = [f"1 / (1 + exp(-l{k})) AS p{k}" for k in range(BUNDLE.k_steps)]
    mean, std = baseline or (_d(BUNDLE.baseline["mean"]), _d(BUNDLE.baseline["std"]))
    return f"""{frame}, sums AS (SELECT capture_id, step_index, w, any_value(flow_count) AS
  flow_count, avg(({_ahead(1)} - s) * ({_ahead(1)} - s)) AS mse, {', '.join(sums)}
  FROM seqs GROUP BY 1, 2, 3),{between}
heads AS (SELECT *, {', '.join(picks)}, {', '.join(probs)}, 1 / (1 + exp(-((mse - {mean})
  / ({std} + {_d(1e-8)}) - 3))) AS cal FROM sums),
risks AS (SELECT *, greatest(p0, cal) AS risk FROM heads),
windows AS (SELECT *, round(risk, 4) AS current_risk,
  {_stage(f'(CASE WHEN risk < {THRESHOLD} THEN 0 ELSE m0 END)')} AS current_stage FROM risks)"""


def _forecast() -> str:
    parts = [
        "SELECT capture_id, step_index, CAST(0 AS INTEGER) AS point, 'T_0 (Observed)' AS"
        " time_key, current_risk AS probability, current_stage AS stage FROM windows"
    ]
    for k in range(BUNDLE.k_steps):
        gated = f"(CASE WHEN p{k} < {THRESHOLD} THEN 0 ELSE m{k} END)"
        parts.append(
            f"SELECT capture_id, step_index, {k + 1}, "
            f"'{horizon_labels(k + 1, BUNDLE.window_size)[k]}', round(p{k}, 4), {_stage(gated)}"
            " FROM windows"
        )
    return f"WITH {_scored()} " + " UNION ALL ".join(parts)


SUMMARY = f"""SELECT capture_id, count(*) AS total_windows_evaluated,
  count(*) FILTER (current_risk >= {THRESHOLD}) AS anomalous_windows_detected,
  {_d(THRESHOLD)} AS model_threshold, CASE WHEN count(*) FILTER (current_risk >= {THRESHOLD}) > 0
  THEN '{VERDICT_ATTACK}' ELSE '{VERDICT_CLEAR}' END AS verdict FROM windows GROUP BY capture_id"""


MARKS = """marks AS (SELECT user_id % 4 AS capture_id, date_trunc('hour', ts) AS w,
  4 * count(*) FILTER (event_type = 'purchase') > count(*) AS attack FROM events GROUP BY 1, 2)"""
LOGGED = f"""{_states('hour')}, logged AS (SELECT *, sign(v) * ln(1 + abs(v)) AS g FROM long),
scaler AS (SELECT dim, avg(g) AS mean, CASE WHEN min(v) = max(v) THEN 1 ELSE stddev_pop(g) END
  AS scale FROM logged GROUP BY dim)"""
REFITTED = f"""{LOGGED}, scaled AS (SELECT l.*, greatest({_d(-3.0)}, least({_d(3.0)},
  (g - mean) / scale)) AS s FROM logged l JOIN scaler USING (dim))"""
BASELINE = f"""{MARKS}, base AS (SELECT avg(mse) AS mean, stddev_pop(mse) AS std, count(*) AS
  windows FROM sums JOIN marks USING (capture_id, w) WHERE NOT attack)"""


def _share(of: str, whole: str) -> str:
    return f"round(CAST({of} AS DOUBLE) / nullif({whole}, 0), 6)"


# --- rolling buffer -----------------------------------------------------------------

SHUFFLED = f"((event_id * 7919) % 10007 * {1 << 40} + event_id)"
JITTERED = "((event_id + (event_id * 7919) % 101) * 128 + event_id % 128)"
WHOLE_SECOND = "CASE WHEN event_id % 3 = 2 THEN ts ELSE date_trunc('second', ts) END"
EPOCH_TEXT = """concat(CAST(epoch_us(ts) // 1000000 AS VARCHAR), '.',
 lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0'))"""
ARRIVALS = f"""arrivals AS (SELECT event_id, user_id, {SHUFFLED} AS arrival_seq,
  concat('f', event_id) AS _id, epoch_us({WHOLE_SECOND}) / {_d(1e6)} AS ts_epoch, ts,
  concat('10.0.0.', user_id % 256) AS src_ip, {PORT} AS dst_port, {PROTOCOL} AS protocol
  FROM events)"""


def _kept(retention: float) -> str:
    return f"""inserts AS (SELECT concat('s', user_id % 4) AS sensor, {JITTERED} AS arrival_seq,
  concat('f', event_id) AS _id, epoch_us({WHOLE_SECOND}) / {_d(1e6)} AS ts_epoch FROM events),
kept AS (SELECT * FROM inserts QUALIFY max(ts_epoch) OVER (PARTITION BY sensor ORDER BY arrival_seq
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - {_d(float(retention))} <= ts_epoch)"""


REINSERTED = f"""WITH first_time AS (SELECT concat('s', user_id % 4) AS sensor,
  {JITTERED} AS arrival_seq, concat('f', event_id) AS _id,
  epoch_us({WHOLE_SECOND}) / {_d(1e6)} AS ts_epoch FROM events),
inserts AS (SELECT * FROM first_time UNION ALL SELECT sensor, arrival_seq + {1 << 44}, _id,
  ts_epoch - 60 FROM first_time WHERE arrival_seq % 3 = 0),
marked AS (SELECT *, max(ts_epoch) OVER (PARTITION BY sensor ORDER BY arrival_seq
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach,
  max(arrival_seq) OVER (PARTITION BY sensor, _id) AS last_insert FROM inserts)
SELECT sensor, arrival_seq, _id, ts_epoch FROM marked
WHERE reach - {_d(float(SENSOR_RETENTION))} <= ts_epoch AND arrival_seq = last_insert"""

# --- sensor logs --------------------------------------------------------------------

_V = ad.log_values()


def _log_cells(log: str) -> str:
    fields = ad.LOG_COMMON + ad.LOG_FIELDS[log]
    cells = [f"({_V[f]})" for f in fields]
    cells[-1] = f"(CASE WHEN event_id % 17 = 0 THEN NULL ELSE {cells[-1]} END)"
    cells.append("(CASE WHEN event_id % 19 = 0 THEN '' END)")
    return ", ".join(cells)


_LOG_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ad.LOG_OF_TYPE.items())
_LINE_CASE = " ".join(
    f"WHEN '{log}' THEN concat_ws(sep, {_log_cells(log)})" for log in ad.LOG_FIELDS
)
_FIELD_CASE = " ".join(
    f"WHEN '{log}' THEN {_text(ad.LOG_COMMON + f)}" for log, f in ad.LOG_FIELDS.items()
)
LINES = f"""base AS (SELECT event_id, user_id, CASE event_type {_LOG_CASE} END AS log,
  {EPOCH_TEXT} AS epoch_text, CAST(round(value * 100) AS BIGINT) AS cents,
  event_id // {ad.BLOCK_EVENTS} AS block FROM events),
cut AS (SELECT *, concat(CAST(cents // 100 AS VARCHAR), '.',
  lpad(CAST(cents % 100 AS VARCHAR), 2, '0')) AS cents_text,
  CASE WHEN log = 'ssl' AND block >= 1 THEN '|' ELSE chr(9) END AS sep FROM base),
lines AS (SELECT event_id, block, log, concat(log, '-', user_id % 4) AS file,
  CASE log {_FIELD_CASE} END AS fields, CASE WHEN sep = '|' THEN 'none' ELSE '-' END AS unset,
  string_split(CASE log {_LINE_CASE} END, sep) AS parts FROM cut),
good AS (SELECT * FROM lines WHERE len(parts) = len(fields)),
cells AS (SELECT file, event_id, log, block, unnest(fields) AS field, unnest(parts) AS raw, unset
  FROM good),
rec AS (SELECT file, event_id, log, block, field, CASE WHEN raw <> unset AND raw <> '(empty)'
  THEN raw END AS value FROM cells)"""

ISO = """CASE WHEN micros % 1000000 = 0 THEN strftime(make_timestamp(micros), '%Y-%m-%dT%H:%M:%SZ')
 ELSE strftime(make_timestamp(micros), '%Y-%m-%dT%H:%M:%S.%fZ') END"""


def _f(name: str) -> str:
    return f"max(value) FILTER (field = '{name}')"


def _whole(name: str, kind: str) -> str:
    x = _f(name)
    return f"CASE WHEN regexp_full_match(trim({x}), '[-+]?[0-9]+') THEN CAST(trim({x}) AS {kind}) END"


def _real(name: str) -> str:
    x = _f(name)
    return f"CASE WHEN NOT regexp_matches({x}, '[df]$') THEN try_cast({x} AS DOUBLE) END"


_STAMP = f"""CASE WHEN {_f('ts')} = 'no-time' THEN NULL
 ELSE CAST(replace({_f('ts')}, '.', '') AS BIGINT) END AS micros"""
_BODY_SQL = {"text": _f, "real": _real, "long": lambda n: _whole(n, "BIGINT"), "port": lambda n: _whole(n, "INTEGER")}


def _wide_events(logs: str) -> str:
    seen: dict[str, str] = {}
    for layout in EVENT_BODY.values():
        for name, field, kind in layout:
            seen.setdefault(name, f"{_BODY_SQL[kind](field)} AS {name}")
    return f"""wide AS (SELECT event_id, log, any_value(block) AS block, {_f('ts')} AS ts_text, {_STAMP},
  {_f('id.orig_h')} AS src_ip, {_whole('id.orig_p', 'INTEGER')} AS src_port,
  {_f('id.resp_h')} AS dst_ip, {_whole('id.resp_p', 'INTEGER')} AS dst_port,
  {_f('server_name')} AS server_name, {_f('msg')} AS msg, {', '.join(seen.values())}
  FROM rec WHERE log IN ({logs}) GROUP BY event_id, log),
stamped AS (SELECT *, CASE WHEN micros IS NULL THEN ts_text ELSE {ISO} END AS timestamp,
  CASE WHEN log = 'conn' THEN 'connection' ELSE log END AS event_type FROM wide)"""


def _typed_events(log: str) -> str:
    body = ", ".join(name for name, _, _ in EVENT_BODY[log])
    return f"""WITH {LINES}, {_wide_events(f"'{log}'")} SELECT timestamp, event_type, src_ip,
  src_port, dst_ip, dst_port, {body} FROM stamped"""


_SLOT_ENDS = "date_trunc('hour', ts) + INTERVAL 1 HOUR"
_LIMIT = f"make_timestamp({int((RETAINED_TO - 600) * 1e6)})"
ALL_LOGS = ", ".join(f"'{log}'" for log in ad.LOG_FIELDS)
EVENT_ROWS = """SELECT timestamp, event_type, src_ip, src_port, duration, status_code, query,
 server_name, msg FROM stamped"""
# Blocks that have a header of their own: each file's first, and block 1 of ssl logs.
def _slot(length: int) -> str:
    return f"""lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || '-' ||
 lpad(CAST(minute(ts) // {length} * {length} AS VARCHAR), 2, '0')"""


def _left(length: int) -> str:
    return f"""CAST(greatest(1, (least(minute(ts) // {length} * {length} + {length}, 60)
 - minute(ts)) * 60 - CAST(floor(second(ts)) AS INTEGER)) AS INTEGER)"""


def _wide() -> str:
    """Every numeric column of the full flow records, by hour."""
    named = {"src_port": "1024 + event_id % 50000", "dst_port": PORT, "protocol": PROTOCOL}
    words = ("iat", "active", "idle", "duration")
    columns, cells = [], []
    for i, c in enumerate(ad.FLOW_COLUMNS):
        if c not in ad.WIDE_FEATURES:
            continue
        value = f"CAST({named.get(c, f'(event_id * {i + 3} + user_id) % 1009')} AS DOUBLE)"
        scale = f" * {_d(1e6)}" if any(w in c for w in words) else ""
        columns.append(f"{value}{scale} AS f_{c}")
        cells.append(f"f_{c}")
    def each(fn: str) -> str:
        return ", ".join(f"{fn}({c})" for c in cells)
    names = state_names(ad.WIDE_FEATURES)
    meta = META.replace("x0", "f_dst_port").replace("x1", "f_protocol")
    return f"""WITH f AS (SELECT user_id % 4 AS capture_id, date_trunc('hour', ts) AS w,
  {', '.join(columns)} FROM events), states AS (SELECT capture_id, w, [{each('avg')},
  {each('stddev_pop')}, {each('min')}, {each('max')}, {meta}] AS state FROM f GROUP BY 1, 2),
long AS (SELECT unnest({_text(names)}) AS feature, unnest(state) AS v FROM states)
SELECT feature, count(*) AS windows, round(avg(v), 2) AS average, round(max(v), 2) AS largest
FROM long GROUP BY feature"""


def _moments() -> str:
    keep = range(len(ad.FEATURES))
    names = [f"std_{f}" for f in ad.FEATURES]
    cells = ", ".join(
        f"sqrt(greatest(avg(x{i} * x{i}) - avg(x{i}) * avg(x{i}), 0))" for i in keep
    )
    return f"""WITH {CLEAN}, states AS (SELECT capture_id, date_trunc('hour', ts) AS w,
  [{cells}] AS s FROM flows GROUP BY 1, 2), long AS (SELECT capture_id, w,
  unnest({_text(names)}) AS feature, unnest(s) AS v FROM states)
SELECT capture_id, {AT.format('w')} AS window_start, feature, CASE WHEN regexp_matches(
  lower(feature), 'iat|active|idle|duration') THEN round(v, 0) ELSE round(v, 4) END AS value FROM long"""


_SPELLINGS = "[' 12 ', '12.0', '1e3', '', '-', '1.5d', '1.5f', '-7', 'abc'][event_id % 9 + 1]"

STATIC: dict[str, str] = {
    "flow_clean": f"""WITH {CLEAN} SELECT capture_id, event_id, {AT.format('ts')} AS at,
  {', '.join(f'round(x{i}, 6) AS x{i}' for i in range(N))} FROM flows""",
    "window_state_1min": _state_rows("minute"),
    "window_state_1h": _state_rows("hour"),
    "window_state_rollup": _state_rows("hour"),
    "window_state_moments": _moments(),
    "window_state_wide": _wide(),
    "window_meta": f"""WITH {_states('minute')} SELECT capture_id, {AT.format('w')} AS
  window_start, {_text(NAMES)}[dim + 1] AS feature, round(v, 6) AS value FROM long
  WHERE dim >= {WIDTH - 4}""",
    "signed_log_scale_clip": f"""WITH {SCALED} SELECT capture_id, {AT.format('w')} AS
  window_start, CAST(dim AS INTEGER) AS dim, round(s, 6) AS value FROM scaled""",
    "sequence_frames": f"""WITH {FRAME} SELECT capture_id, step_index, {AT.format('w')} AS
  window_start, CAST(dim AS INTEGER) AS dim, round(fa, 4) AS first_value,
  round(fz, 4) AS last_value, round(fs, 4) AS frame_sum FROM seqs""",
    "capture_window_counts": f"""WITH {_states('hour')} SELECT capture_id, count(*) AS windows,
  count(*) >= {LENGTH + 1} AS enough FROM states GROUP BY capture_id""",
    "hybrid_risk": f"""WITH {_scored()} SELECT capture_id, step_index, {AT.format('w')} AS
  window_start, strftime(w, '%H:%M:%S') AS timestamp, flow_count, round(p0, 4) AS
  attack_head_prob, round(mse, 6) AS raw_mse, round(cal, 4) AS calibrated_mse, current_risk,
  current_stage FROM windows""",
    "risk_without_baseline": f"""WITH {_scored()} SELECT capture_id, step_index,
  CAST(NULL AS DOUBLE) AS calibrated_mse, round(p0, 4) AS current_risk,
  {_stage(f'(CASE WHEN p0 < {THRESHOLD} THEN 0 ELSE m0 END)')} AS current_stage FROM windows""",
    "detection_log": f"""WITH {_scored()} SELECT capture_id, step_index,
  strftime(w, '%H:%M:%S') AS timestamp, current_risk AS attack_prob,
  current_risk >= {THRESHOLD} AS is_attack FROM windows""",
    "detection_summary": f"WITH {_scored()} {SUMMARY}",
    "risk_band": f"""WITH {_scored()} SELECT capture_id, step_index, current_risk,
  CASE WHEN current_risk > 0.6 THEN 'Critical Anomaly' WHEN current_risk > 0.3
   THEN 'Elevated Drift' ELSE 'Nominal Physics' END AS band,
  CASE WHEN current_risk >= {THRESHOLD} THEN 'Flagged' ELSE 'Nominal' END AS status,
  concat(tenths // 10, '.', tenths % 10, '%') AS percent FROM (SELECT *,
  (CAST(current_risk * 100 * pow(2, 80) AS HUGEINT) * 10 + CAST(pow(2, 79) AS HUGEINT))
   // CAST(pow(2, 80) AS HUGEINT) AS tenths FROM windows)""",
    "forecast_points": _forecast(),
    "top_features": f"""WITH {FRAME}, imp AS (SELECT capture_id, step_index, dim,
  abs(fz * {ATTACK}) / {_d(float(LENGTH))} AS v FROM seqs),
ranked AS (SELECT *, max(v) OVER g AS top, row_number() OVER (PARTITION BY capture_id, step_index
  ORDER BY v DESC, dim) - 1 AS r FROM imp WINDOW g AS (PARTITION BY capture_id, step_index))
SELECT capture_id, step_index, CAST(r AS INTEGER) AS rank, {_text(NAMES)}[dim + 1] AS feature,
  round(v / CASE WHEN top > 0 THEN top ELSE 1 END, 4) AS importance FROM ranked WHERE r < 3""",
    "bundle_stored": f"""WITH {LOGGED} SELECT CAST(dim AS INTEGER) AS dim, round(mean, 6) AS mean,
  round(scale, 6) AS scale FROM scaler""",
    "fit_scaler": f"""WITH {LOGGED} SELECT CAST(dim AS INTEGER) AS dim, round(mean, 6) AS mean,
  round(scale, 6) AS scale FROM scaler""",
    "fit_benign_baseline": f"""WITH {_scored(between=BASELINE + ',')} SELECT round(mean, 6) AS mean,
  round(std, 6) AS std, windows FROM base""",
    "eval_binary": f"""WITH {_scored()}, {MARKS}, c AS (SELECT
  count(*) FILTER (p AND attack) AS tp, count(*) FILTER (p AND NOT attack) AS fp,
  count(*) FILTER (NOT p AND attack) AS fn, count(*) FILTER (NOT p AND NOT attack) AS tn
  FROM (SELECT capture_id, w, current_risk >= {THRESHOLD} AS p FROM windows)
  JOIN marks USING (capture_id, w)) SELECT *, {_share('tp', 'tp + fp')} AS precision,
  {_share('tp', 'tp + fn')} AS recall, {_share('2 * tp', '2 * tp + fp + fn')} AS f1,
  {_share('fp', 'fp + tn')} AS false_positive_rate FROM c""",
    "fitted_detection": f"""WITH {_scored(_framed(REFITTED), BASELINE + ',',
  ('(SELECT mean FROM base)', '(SELECT std FROM base)'))} {SUMMARY}""",
    "tactic_names": f"""SELECT {_stage('(event_id % 9)')} AS tactic, count(*) AS n FROM events
  GROUP BY 1""",
    "state_dimension_names": f"""WITH i AS (SELECT event_id % {WIDTH + 2} AS i FROM events)
SELECT CASE WHEN i < {WIDTH} THEN {_text(NAMES)}[i + 1] ELSE concat('dim_', i) END AS feature,
  count(*) AS n FROM i GROUP BY 1""",
    "scenario_list": """SELECT concat('capture_0', c) AS id, CASE WHEN c = 1 THEN 'Replaced'
  ELSE concat('Ingested Dataset: ', c) END AS name, concat('Uploaded capture (', c, ')') AS target
  FROM (SELECT DISTINCT user_id % 4 AS c FROM events)""",
    "scenario_metadata": f"""WITH {_scored()}, n AS (SELECT user_id % 4 AS capture_id,
  count(*) AS rows_ingested FROM events GROUP BY 1)
SELECT concat('capture_0', capture_id) AS scenario_id, count(*) AS total_windows,
  any_value(rows_ingested) AS rows_ingested,
  count(*) FILTER (current_risk >= {THRESHOLD}) AS attack_windows_detected,
  'event_id,timestamp,dst_port,protocol,flow_duration,tot_fwd_pkts,flow_iat_mean,cwr_flag_count'
   AS detected_features FROM windows JOIN n USING (capture_id) GROUP BY capture_id""",
    "scenario_step": f"""WITH {_scored()} SELECT 'capture_02' AS scenario_id,
  'Uploaded capture (2)' AS target_asset, step_index,
  (SELECT count(*) FROM windows WHERE capture_id = 2) AS total_steps,
  strftime(w, '%H:%M:%S') AS timestamp, current_risk FROM windows
  WHERE capture_id = 2 AND step_index = 3""",
    "scenario_windows": f"""WITH {_scored()} SELECT concat('capture_0', capture_id) AS
  scenario_id, CASE WHEN capture_id = 1 THEN 'Replaced' ELSE concat('Ingested Dataset: ',
  capture_id) END AS name, step_index, current_risk,
  count(*) OVER (PARTITION BY capture_id) AS total_windows FROM windows""",
    "epoch_parse": f"WITH {ARRIVALS} SELECT event_id, ts_epoch FROM arrivals",
    "rolling_buffer": f"""WITH {ARRIVALS} SELECT arrival_seq, _id, ts_epoch FROM arrivals
  QUALIFY max(ts_epoch) OVER (ORDER BY arrival_seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED
  FOLLOWING) - 300 <= ts_epoch""",
    "rolling_buffer_sensors": f"""WITH {_kept(SENSOR_RETENTION)}
  SELECT sensor, arrival_seq, _id, ts_epoch FROM kept""",
    "rolling_buffer_reinserted": REINSERTED,
    "buffer_sizes": f"""WITH {_kept(SENSOR_RETENTION)}, gone AS (
  SELECT a.sensor, a.arrival_seq, min(b.arrival_seq) AS last FROM inserts a JOIN inserts b
  ON a.sensor = b.sensor AND b.arrival_seq > a.arrival_seq
   AND b.ts_epoch - {_d(float(SENSOR_RETENTION))} > a.ts_epoch GROUP BY 1, 2),
leaves AS (SELECT sensor, last AS arrival_seq, count(*) AS n FROM gone GROUP BY 1, 2)
SELECT sensor, arrival_seq, CAST(sum(1 - coalesce(n, 0)) OVER (PARTITION BY sensor
  ORDER BY arrival_seq) AS BIGINT) AS flow_count
FROM inserts LEFT JOIN leaves USING (sensor, arrival_seq)""",
    "buffer_range": f"""WITH {ARRIVALS} SELECT ts_epoch, _id, src_ip, dst_port FROM arrivals
  WHERE ts_epoch BETWEEN {_d(RANGE[0])} AND {_d(RANGE[1])}""",
    "buffer_range_by_zones": f"""WITH {ARRIVALS} SELECT ts_epoch, _id, src_ip, dst_port FROM arrivals
  WHERE ts_epoch BETWEEN {_d(RANGE[0])} AND {_d(RANGE[1])}""",
    "buffer_ends_by_zones": f"""WITH {ARRIVALS} (SELECT 'oldest' AS "end", ts_epoch FROM arrivals
  ORDER BY ts_epoch LIMIT 7) UNION ALL (SELECT 'newest', ts_epoch FROM arrivals
  ORDER BY ts_epoch DESC LIMIT 7)""",
    "buffer_prune": f"""WITH {ARRIVALS} SELECT CASE WHEN ts_epoch < {_d(RANGE[1] - 7 * 86400)}
  THEN 'removed' ELSE 'kept' END AS state, count(*) AS flows FROM arrivals GROUP BY 1""",
    "buffer_stats": f"""WITH {_kept(SENSOR_RETENTION)} SELECT count(*) AS flow_count,
  min(ts_epoch) AS oldest, max(ts_epoch) AS newest, max(ts_epoch) - min(ts_epoch) AS span
  FROM kept""",
    "buffer_oldest5": f"""WITH {_kept(SENSOR_RETENTION)} SELECT ts_epoch, _id FROM kept
  ORDER BY ts_epoch LIMIT 5""",
    "buffer_newest5": f"""WITH {_kept(SENSOR_RETENTION)} SELECT ts_epoch, _id FROM kept
  ORDER BY ts_epoch DESC LIMIT 5""",
    "flow_summary": f"""WITH {ARRIVALS} SELECT ts_epoch, concat(strftime(make_timestamp(CAST(round(
  ts_epoch * 1000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S.'), lpad(CAST(CAST(round(ts_epoch * 1000000)
  AS BIGINT) % 1000000 // 1000 AS VARCHAR), 3, '0')) AS at,
  concat('[', CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1
   THEN strftime(ts, '%d/%m/%Y %H:%M:%S') ELSE {EPOCH_TEXT} END, '] ', src_ip, ':',
   1024 + event_id % 50000, ' -> ', CASE WHEN event_id % 7 <> 0 THEN '192.168.1.100' ELSE 'N/A'
   END, ':', dst_port, ' (', protocol, ')') AS flow FROM arrivals""",
    "zeek_parse": f"""WITH {LINES} SELECT file, event_id * 2 AS pos, log AS path, field, value
  FROM rec""",
    "zeek_rejects": f"""WITH {LINES} SELECT log AS path,
  count(*) FILTER (len(parts) = len(fields)) AS kept,
  count(*) FILTER (len(parts) <> len(fields)) AS rejected FROM lines GROUP BY log""",
    "zeek_conn": _typed_events("conn"),
    "zeek_dns": _typed_events("dns"),
    "zeek_http": _typed_events("http"),
    "zeek_generic": f"""WITH {LINES}, {_wide_events("'ssl', 'notice'")} SELECT timestamp,
  event_type, src_ip, src_port, dst_ip, dst_port, field, value
  FROM stamped JOIN (SELECT event_id, field, value FROM rec) r USING (event_id)
  WHERE field NOT IN ('ts', 'id.orig_h', 'id.orig_p', 'id.resp_h', 'id.resp_p')""",
    "event_sink": f"WITH {LINES}, {_wide_events(ALL_LOGS)} {EVENT_ROWS}",
    "log_file_scan": f"""WITH {LINES}, {_wide_events(ALL_LOGS)}
SELECT event_type, count(*) AS events, count(src_port) AS with_port, sum(orig_bytes)::BIGINT AS
  orig_bytes FROM stamped GROUP BY event_type""",
    "log_times": f"""WITH t AS (SELECT event_id, epoch_us(ts) AS micros FROM events)
SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'no-time' ELSE {ISO} END AS timestamp FROM t""",
    "safe_numbers": f"""SELECT event_id, CASE WHEN regexp_full_match(trim({_SPELLINGS}),
  '[-+]?[0-9]+') THEN CAST(trim({_SPELLINGS}) AS BIGINT) END AS whole,
  CASE WHEN NOT regexp_matches({_SPELLINGS}, '[df]$') THEN try_cast({_SPELLINGS} AS DOUBLE) END
  AS "real" FROM events""",
    "buffer_append_batches": f"""WITH e AS (SELECT event_id, epoch_us(ts) AS t,
  row_number() OVER (ORDER BY event_id % 3, event_id) AS seq FROM events)
SELECT event_id FROM (SELECT *, max(t) OVER (ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED
  FOLLOWING) AS newest FROM e) WHERE newest - {SENSOR_RETENTION}::BIGINT * 1000000 <= t""",
    "slot_keys": f"""SELECT event_id, strftime(ts, '%Y-%m-%d') AS slot_date, {_slot(15)} AS
  slot_15, {_slot(25)} AS slot_25, concat('flows_', strftime(ts, '%Y-%m-%d'), '_', {_slot(5)},
  '.csv') AS file_name FROM events""",
    "next_slot_seconds": f"""SELECT event_id, {_left(1)} AS left_1, {_left(5)} AS left_5,
  {_left(25)} AS left_25 FROM events""",
    "normalize_names": """SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS name,
  count(*) AS n FROM (SELECT p_name AS name FROM part UNION ALL SELECT c_name FROM customer)
  GROUP BY 1""",
    "flow_fields": f"""SELECT event_id, {AT.format('ts')} AS timestamp, {PORT} AS dst_port
  FROM events""",
    "flow_csv_scan": f"""WITH {CLEAN} SELECT event_id, {AT.format('ts')} AS at,
  round(round(x2 / 10000) * {_d(1e6)}, 3) AS duration, round(x3, 3) AS packets FROM flows""",
    "flow_csv_orders": f"""WITH {CLEAN} SELECT event_id, {AT.format('ts')} AS at,
  CAST(x0 AS BIGINT) AS dst_port, round(round(x2 / 10000) * {_d(1e6)}, 3) AS duration,
  round(x3, 3) AS packets FROM flows""",
    "flow_csv_merge": f"""SELECT count(*) AS flows, count(*) FILTER (user_id % 2 = 0) AS with_cwr,
  CAST(sum({PORT}) AS BIGINT) AS ports FROM events""",
    "flow_csv_captures": f"""SELECT event_id, CAST({PORT} AS BIGINT) AS dst_port,
  CASE WHEN event_id % 3 <> 1 THEN event_id % 3 END AS cwr,
  CASE WHEN event_id % 3 = 2 THEN 'x, y' END AS label,
  CAST([8, 7, 9][event_id % 3 + 1] AS INTEGER) AS cells FROM events""",
    "retention_report": f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT hour(ts)) AS
  slots FROM events WHERE {_SLOT_ENDS} < {_LIMIT} GROUP BY 1""",
    "retention_clean": f"""SELECT count(*) FILTER ({_SLOT_ENDS} >= {_LIMIT}) AS events,
  min(event_id) FILTER ({_SLOT_ENDS} >= {_LIMIT}) AS first_event,
  count(DISTINCT date_trunc('hour', ts)) FILTER ({_SLOT_ENDS} < {_LIMIT}) AS slots_gone,
  true AS counted FROM events""",
    "expired_event_files": """SELECT '2100' AS at, strftime(ts, '%Y-%m-%d') AS day,
  count(DISTINCT hour(ts)) AS slots FROM events GROUP BY 2""",
    "flow_times_dropped": """SELECT user_id % 4 AS capture_id, count(*) AS read,
  count(*) FILTER (event_id % 23 <> 0 AND event_id % 29 <> 0) AS kept,
  CAST(sum(event_id) FILTER (event_id % 23 <> 0 AND event_id % 29 <> 0) AS BIGINT) AS ids
  FROM events GROUP BY 1""",
    "flow_table_checks": """WITH n AS (SELECT count(*) > 0 AS filled FROM events),
c AS (SELECT unnest(['src_ip', 'dst_ip', 'src_port', 'dst_port', 'protocol']) AS name)
SELECT 'wide' AS flows, concat('column ', name) AS "check", true AS passed FROM c
UNION ALL SELECT 'empty', concat('column ', name), true FROM c
UNION ALL SELECT 'narrow', concat('column ', name), name IN ('dst_port', 'protocol') FROM c
UNION ALL SELECT 'wide', 'has data rows', filled FROM n
UNION ALL SELECT 'narrow', 'has data rows', filled FROM n
UNION ALL SELECT 'empty', 'has data rows', false FROM n
UNION ALL SELECT unnest(['wide', 'narrow', 'empty']), 'at least 70 columns', unnest([true, false, true])""",
    "buffer_cleared": f"""WITH {_kept(SENSOR_RETENTION)} SELECT count(*) AS filled,
  CAST(0 AS BIGINT) AS cleared, count(*) FILTER (arrival_seq % 2 = 0) AS again FROM inserts""",
    "log_fan_in": f"""WITH {LINES}, sensors AS (SELECT *, split_part(file, '-', 2) AS sensor FROM good)
SELECT CASE sensor WHEN '0' THEN concat(log, '.log') ELSE concat(log, '.day-', sensor, '.log') END
  AS file, log AS path, count(*) AS records, CAST(sum(len(fields)) AS BIGINT) AS cells
FROM sensors WHERE sensor <> '1' GROUP BY 1, 2""",
    "stream_event_counts": f"""WITH {LINES} SELECT count(*) AS events FROM good""",
    "stream_late_rows": f"""WITH first AS (SELECT max(ts) AS newest FROM events WHERE event_id % 3 <> 0),
late AS (SELECT event_id, ts FROM events, first WHERE event_id % 3 = 0
  AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= newest - INTERVAL 90 MINUTE)
SELECT event_id, {AT.format('ts')} AS at, (SELECT count(*) FROM events) AS rows,
  (SELECT count(*) FROM late) AS late_rows FROM late""",
    "stream_window_state": _state_rows("hour"),
    "stream_rolling_buffer": f"""WITH {_kept(SENSOR_RETENTION)}
  SELECT sensor, arrival_seq, _id, ts_epoch FROM kept""",
    "stream_default_rows": f"""WITH e AS (SELECT event_id, epoch_us(ts) AS t,
  row_number() OVER (ORDER BY event_id % 4, event_id) AS seq FROM events)
SELECT event_id, t / {_d(1e6)} AS ts_epoch FROM (SELECT *, max(t) OVER (ORDER BY seq ROWS BETWEEN
  CURRENT ROW AND UNBOUNDED FOLLOWING) AS newest FROM e)
WHERE newest - {SENSOR_RETENTION}::BIGINT * 1000000 <= t""",
    "stream_flow_archive": f"""SELECT concat('f', event_id) AS _id, CASE event_id % 3 WHEN 0
  THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%d/%m/%Y %H:%M:%S')
  ELSE {EPOCH_TEXT} END AS timestamp, {PORT} AS dst_port FROM events""",
    "stream_unique_ids": f"""SELECT concat('f', event_id) AS _id, {AT.format('ts')} AS at
  FROM events""",
    "stream_event_log": f"""WITH {LINES}, {_wide_events(ALL_LOGS)}
  {EVENT_ROWS}""",
}
