"""Names: column matching, state dimensions, forecast horizons, tactics."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.schemas import TACTIC_NAMES

STATISTICS = ("mean", "std", "min", "max")
META_NAMES = (
    "meta_log_flow_count",
    "meta_log_unique_ports",
    "meta_unique_protocols",
    "meta_high_port_ratio",
)


# Fixed value: what the comparison of column names leaves out.
MATCHED_AWAY = "[^a-z0-9]"


def match_name(name: str) -> str:
    """Spelling-free form of a column name: 'Flow Byts/s' and 'flow_byts_s' agree."""
    return re.sub(MATCHED_AWAY, "", str(name).lower())


def match_name_col(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), MATCHED_AWAY, "")


def state_names(feature_cols: Sequence[str]) -> list[str]:
    """Dimension names of a state vector, in order."""
    return [f"{stat}_{f}" for stat in STATISTICS for f in feature_cols] + list(META_NAMES)


def text_array(values: Sequence[str]) -> Column:
    """Constant array of texts."""
    cut = "\x1f"
    return F.split(F.lit(cut.join(values)), cut)


def dimension_name(names: Sequence[str], index: Column) -> Column:
    """Name of state dimension ``index`` (from 0); ``dim_<index>`` beyond the known ones."""
    known = F.get(text_array(names), index.cast("int"))
    return F.coalesce(known, F.concat(F.lit("dim_"), index.cast("string")))


# How a horizon is written in seconds, minutes, parts of minutes, and in steps.
HORIZON_TEXTS = ("+{:d}s", "+{:d}min", "+{:.1f}min", "+{:d} step(s)")
SECOND, MINUTE = 1_000_000, 60_000_000


def horizon_labels(k_steps: int, window_size: str) -> list[str]:
    """How far ahead each forecast step lies; in steps where the window size is unreadable."""
    in_seconds, in_minutes, in_parts, in_steps = HORIZON_TEXTS
    steps = range(1, k_steps + 1)
    try:
        window = pd.Timedelta(window_size).value // 1000
    except ValueError:
        return [in_steps.format(n) for n in steps]
    labels = []
    for ahead in (n * window for n in steps):
        if ahead < MINUTE:
            labels.append(in_seconds.format(ahead // SECOND))
        elif ahead % MINUTE:
            labels.append(in_parts.format(ahead / MINUTE))
        else:
            labels.append(in_minutes.format(ahead // MINUTE))
    return labels


def tactic_name(cls: Column) -> Column:
    """Tactic of a class number, 'Unknown' outside the seven."""
    pairs = [F.lit(x) for item in TACTIC_NAMES.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), cls.cast("int")), F.lit("Unknown"))
