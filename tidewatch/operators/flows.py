"""Cleaning of wide flow records: names, units, time, numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.names import match_name
from tidewatch.functions.numeric import clean_number, raw_number
from tidewatch.functions.timeparse import FLOW_FORMATS, flow_time
from tidewatch.plans.materialize import computed_once

TIME_COLUMN = "Timestamp"
# A column whose lower-cased name contains one of these holds a time span.
SPAN_WORDS = ("iat", "active", "idle", "duration")
# Other spellings of a model column.
ALIASES = {"cwrflagcount": "cweflagcount"}


class FlowInputError(ValueError):
    """The flow table cannot be used as it is."""


def is_span(name: str) -> bool:
    return any(word in name.lower() for word in SPAN_WORDS)


def target_names(columns: Sequence[str], feature_cols: Sequence[str]) -> dict[str, str]:
    """Column -> model name, for every column that matches one by its spelling-free name."""
    wanted = {match_name(f): f for f in feature_cols}
    wanted["timestamp"] = TIME_COLUMN
    found: dict[str, str] = {}
    for column in columns:
        key = match_name(column)
        target = wanted.get(ALIASES.get(key, key), column if column in feature_cols else None)
        if target is None:
            continue
        if target in found.values():
            raise FlowInputError(f"two columns stand for {target!r}: {column!r} is the second")
        found[column] = target
    if TIME_COLUMN not in found.values():
        raise FlowInputError("the flow table has no recognisable Timestamp column")
    return found


def missing_features(columns: Sequence[str], feature_cols: Sequence[str]) -> list[int]:
    """Positions of the model features that the table does not have."""
    have = set(target_names(columns, feature_cols).values())
    return [i for i, f in enumerate(feature_cols) if f not in have]


def align_flows(
    flows: DataFrame,
    feature_cols: Sequence[str],
    time_unit: str = "s",
    keep_unit: Sequence[str] = (),
    time_formats: Sequence[str] = FLOW_FORMATS,
) -> DataFrame:
    """Rename to the model's columns, turn time spans into microseconds, clean numbers.

    Rows whose time cannot be read are dropped. A missing feature becomes 0.0, as do
    numbers that are unreadable or not finite. Columns the model does not know pass
    through. ``time_unit='us'`` leaves spans alone, ``keep_unit`` exempts single columns.
    """
    if time_unit not in ("s", "us"):
        raise ValueError("time_unit must be 's' or 'us'")
    renamed = target_names(flows.columns, feature_cols)
    features = set(feature_cols)
    types = dict(zip(flows.columns, (f.dataType for f in flows.schema.fields)))
    projected = []
    parsed_time = None
    for column in flows.columns:
        source = F.col(f"`{column}`")
        target = renamed.get(column, column)
        if target == TIME_COLUMN:
            # Already a time: no text round trip.
            if isinstance(types[column], (T.TimestampType, T.TimestampNTZType, T.DateType)):
                value = source.cast("timestamp")
            else:
                parsed_time, value = flow_time(source, time_formats), source
        else:
            scale_up = time_unit == "s" and is_span(column) and column not in keep_unit
            text = not isinstance(types[column], T.NumericType)
            factor = 1e6 if scale_up else None
            if target in features:
                value = clean_number(column, text, factor)
            else:
                value = raw_number(column, text, factor) if scale_up else source
        projected.append(value.alias(target))
    have = set(renamed.values())
    projected += [F.lit(0.0).alias(f) for f in feature_cols if f not in have]
    if parsed_time is not None:
        column = next(c for c, t in renamed.items() if t == TIME_COLUMN)
        flows = computed_once(flows, column, parsed_time)
    return flows.select(*projected).filter(F.col(TIME_COLUMN).isNotNull())


# Columns a usable flow file must have, and how many it needs in all.
ESSENTIAL_COLUMNS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
MINIMUM_COLUMNS = 70


def check_flow_table(flows: DataFrame) -> DataFrame:
    """Quality report of a flow table: one row per check, with ``passed``."""
    header = ",".join(flows.columns).lower()
    checks = [("has data rows", not flows.limit(1).isEmpty())]
    checks += [(f"column {c}", c in header) for c in ESSENTIAL_COLUMNS]
    checks.append((f"at least {MINIMUM_COLUMNS} columns", len(flows.columns) >= MINIMUM_COLUMNS))
    return flows.sparkSession.createDataFrame(checks, "check string, passed boolean")
