"""Time slots of rotated files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _length(rotation_minutes: int) -> int:
    return max(1, int(rotation_minutes))


def slot_minute(ts: Column, rotation_minutes: int) -> Column:
    """First minute of the slot. Slots restart every hour, so 25 minutes gives 0, 25, 50."""
    length = _length(rotation_minutes)
    return (F.floor(F.minute(ts) / length) * length).cast("int")


def slot_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def slot_key(ts: Column, rotation_minutes: int) -> Column:
    """'HH-MM' of the slot."""
    return F.format_string("%02d-%02d", F.hour(ts), slot_minute(ts, rotation_minutes))


def flow_file_name(ts: Column, rotation_minutes: int = 1) -> Column:
    return F.format_string(
        "flows_%s_%s.csv", slot_date(ts), slot_key(ts, rotation_minutes)
    )


def seconds_to_next_slot(ts: Column, rotation_minutes: int = 1) -> Column:
    """Seconds until the next slot starts, at most until the hour ends, at least 1."""
    ending = F.least(slot_minute(ts, rotation_minutes) + _length(rotation_minutes), F.lit(60))
    left = (ending - F.minute(ts)) * 60 - F.floor(F.second(ts))
    return F.greatest(F.lit(1), left.cast("int"))
