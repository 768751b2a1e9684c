"""Log records to typed events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import safe_float, safe_int
from tidewatch.functions.timeparse import log_instant, log_label
from tidewatch.plans.materialize import computed_once
from tidewatch.schemas import EVENT_BODY, EVENT_HEAD, EVENT_TYPE_NAMES


def _field(name: str) -> Column:
    return F.try_element_at(F.col("rec"), F.lit(name))


def _value(path: Column | str, field: str | None, kind: str) -> Column:
    if kind == "type":
        named = EVENT_TYPE_NAMES.get(path, path) if isinstance(path, str) else path
        return F.lit(named) if isinstance(named, str) else named
    if kind == "time":
        return log_label(F.col("_ts"), F.col("_at"))
    text = _field(field)
    if kind == "port":
        return safe_int(text, "int")
    if kind == "long":
        return safe_int(text)
    if kind == "real":
        return safe_float(text)
    return text


def _columns(path: Column | str, layout: Sequence[tuple]) -> list[Column]:
    return [_value(path, field, kind).alias(name) for name, field, kind in layout]


def usable(records: DataFrame) -> DataFrame:
    """Records that can become events, with their time text ``_ts`` and its instant ``_at``.

    They have fields, a path and a time that is not infinite (an infinite epoch is an error
    for that record alone).
    """
    named = records.filter((F.size("rec") > 0) & F.col("path").isNotNull() & (F.col("path") != ""))
    ts = _field("ts")
    read = computed_once(named, "_t", F.struct(ts.alias("text"), safe_float(ts).alias("epoch")))
    infinite = F.abs("_t.epoch") == float("inf")
    finite = read.filter(~F.coalesce(infinite, F.lit(False)))
    timed = computed_once(finite, "_at", log_instant(F.col("_t.epoch")))
    return timed.withColumn("_ts", F.col("_t.text")).drop("_t")


def connection_events(records: DataFrame) -> DataFrame:
    return _typed(records, "conn")


def dns_events(records: DataFrame) -> DataFrame:
    return _typed(records, "dns")


def http_events(records: DataFrame) -> DataFrame:
    return _typed(records, "http")


def _typed(records: DataFrame, path: str) -> DataFrame:
    layout = EVENT_HEAD + EVENT_BODY[path]
    return usable(records.filter(F.col("path") == path)).select(*_columns(path, layout))


def _unread_fields() -> Column:
    """Fields of a record that the common columns do not use."""
    used = [field for _, field, _ in EVENT_HEAD if field]
    return F.map_filter("rec", lambda k, v: ~k.isin(used + ["_path"]))


def other_events(records: DataFrame) -> DataFrame:
    """Events of all other logs: the common columns and ``extra``, the untouched rest."""
    rest = usable(records.filter(~F.col("path").isin(list(EVENT_BODY))))
    return rest.select(*_columns(F.col("path"), EVENT_HEAD), _unread_fields().alias("extra"))


def all_events(records: DataFrame) -> DataFrame:
    """Every event in one pass: all typed columns, ``extra`` and its JSON text.

    ``json`` holds exactly the columns of the event's own type, nulls included. In other
    logs a field named like a common column replaces it, as later keys do in a JSON object.
    """
    usable_records = usable(records)
    path = F.col("path")
    known = list(EVENT_BODY)
    event_type = F.coalesce(
        *[F.when(path == p, F.lit(n)) for p, n in EVENT_TYPE_NAMES.items()], path
    )
    # Logs that share a column read it from the same field.
    logs_of: dict[tuple, list[str]] = {}
    for log, layout in EVENT_BODY.items():
        for column in layout:
            logs_of.setdefault(column, []).append(log)
    body = {
        name: F.when(path.isin(logs), _value(path, field, kind))
        for (name, field, kind), logs in logs_of.items()
    }
    extra = F.when(~path.isin(known), _unread_fields())
    event = F.struct(
        *_columns(event_type, EVENT_HEAD),
        *[c.alias(n) for n, c in body.items()],
        extra.alias("extra"),
    )
    # The JSON text uses every column again.
    typed = computed_once(usable_records, "_event", event).select("path", "_event.*")
    head = [name for name, _, _ in EVENT_HEAD]
    text = F.lit(None).cast("string")
    for log, layout in EVENT_BODY.items():
        names = head + [name for name, _, _ in layout]
        text = F.when(path == log, _json(F.struct(*names))).otherwise(text)
    return typed.withColumn("json", F.coalesce(text, _open_json(head)))


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _open_json(head: Sequence[str]) -> Column:
    """JSON of an event without a fixed layout: common columns, then the extra fields.

    Common columns that an extra field replaces are left out; ports stay numbers.
    """
    extra = F.col("extra")
    parts = [
        F.when(
            ~F.map_contains_key(extra, F.lit(name)),
            F.regexp_replace(_json(F.struct(name)), r"^\{|\}$", ""),
        )
        for name in head
    ]
    rest = F.when(F.size(extra) > 0, F.regexp_replace(_json(extra), r"^\{|\}$", ""))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts, rest), F.lit("}"))
