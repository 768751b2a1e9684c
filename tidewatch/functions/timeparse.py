"""Time text to time and back. Every rule assumes the UTC session time zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.numeric import safe_float

# Day-first texts; the month-first one is reached only where the day-first reading is
# impossible ('02/15/2018').
DAY_FIRST = (
    "d/M/yyyy H:mm:ss[.SSSSSS][.SSS]",
    "d/M/yyyy h:mm:ss a",
    "d/M/yyyy h:mm a",
    "d/M/yyyy H:mm",
    "d/M/yyyy",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
)
# Other spellings accepted by the buffer's parser.
FREE_FORM = (
    "yyyy/M/d H:mm:ss",
    "yyyy/M/d",
    "d MMM yyyy H:mm:ss",
    "d MMM yyyy",
    "MMM d yyyy H:mm:ss",
    "MMM d, yyyy H:mm:ss",
    "MMM d, yyyy",
    "M-d-yyyy H:mm:ss",
    "M-d-yyyy",
)
# Flow files: ISO first, then day-first.
# Flow files keep one convention; a month-first file names its own formats.
FLOW_FORMATS = ("iso",) + tuple(f for f in DAY_FIRST if f.startswith("d/"))

EPOCH_LOW, EPOCH_HIGH = -62135596800.0, 253402300800.0


def parse_text(text: Column, formats: Sequence[str]) -> Column:
    """First format that fits; 'iso' stands for Spark's own ISO reading. Null if none does."""
    tries = [
        F.try_to_timestamp(text) if f == "iso" else F.try_to_timestamp(text, F.lit(f))
        for f in formats
    ]
    return F.coalesce(*tries)


def flow_time(text: Column, formats: Sequence[str] = FLOW_FORMATS) -> Column:
    return parse_text(F.trim(text.cast("string")), formats)


def epoch_of(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def buffer_epoch(value: Column, numeric: bool = False, now: Column | None = None) -> Column:
    """Epoch seconds of a flow's time value; the current time where it has none.

    Order of rules: empty value -> now; number -> that epoch; 'YYYY-MM-DD...' -> ISO;
    'D/M/YYYY...' -> day first; the free-form list; otherwise now. ``numeric`` tells that
    the column holds numbers, where 0 counts as empty (the text '0' does not).
    """
    current = epoch_of(F.current_timestamp() if now is None else now)
    if numeric:
        number = value.cast("double")
        return F.when(number.isNull() | (number == 0), current).otherwise(number)
    text = F.trim(value)
    parsed = (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), parse_text(text, DAY_FIRST))
        .otherwise(parse_text(text, FREE_FORM))
    )
    return F.when(value.isNull() | (value == ""), current).otherwise(
        F.coalesce(safe_float(text), epoch_of(parsed), current)
    )


def iso_label(ts: Column) -> Column:
    """ISO-8601 text with 'Z'; microseconds appear only when there are any."""
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    whole_second = F.unix_micros(ts) % 1_000_000 == 0
    text = F.when(whole_second, F.substring(full, 1, 19)).otherwise(full)
    return F.concat(text, F.lit("Z"))


def log_instant(epoch: Column) -> Column:
    """Time of an epoch number; null for NaN and beyond the years 1 to 9999."""
    in_range = (epoch >= EPOCH_LOW) & (epoch < EPOCH_HIGH)
    return F.when(in_range, F.timestamp_micros(F.rint(epoch * 1e6).try_cast("bigint")))


def log_label(text: Column, instant: Column, now: Column | None = None) -> Column:
    """ISO text of a log record's time; text that is no date passes unchanged."""
    current = F.current_timestamp() if now is None else now
    return (
        F.when(text.isNull() | (text == ""), iso_label(current))
        .when(instant.isNotNull(), iso_label(instant))
        .otherwise(text)
    )


def log_time(text: Column, now: Column | None = None) -> Column:
    """``log_label`` of epoch text in one expression."""
    return log_label(text, log_instant(safe_float(text)), now)


def window_label(ts: Column) -> Column:
    """Clock time of a window."""
    return F.date_format(ts, "HH:mm:ss")


def millisecond_text(epoch: Column) -> Column:
    """Epoch seconds as 'yyyy-MM-dd HH:mm:ss.SSS', the fraction cut, not rounded."""
    micros = F.rint(epoch * 1e6).cast("bigint")
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd HH:mm:ss.SSS")
