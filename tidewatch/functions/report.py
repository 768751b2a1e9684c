"""Decisions and texts derived from a risk score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gate_class(cls: Column, score: Column, threshold: float) -> Column:
    """Class 0 (benign) wherever the score stays below the threshold."""
    return F.when(score < threshold, F.lit(0)).otherwise(cls)


def risk_band(risk: Column) -> Column:
    value = F.coalesce(risk, F.lit(0.0))
    return (
        F.when(value > 0.6, "Critical Anomaly")
        .when(value > 0.3, "Elevated Drift")
        .otherwise("Nominal Physics")
    )


def flag_status(is_attack: Column) -> Column:
    return F.when(is_attack, "Flagged").otherwise("Nominal")


def percent_text(share: Column) -> Column:
    """Share as percent text with one place, rounded on the exact binary value.

    Twenty times the percentage is held as a sum and its rounding error, so a value just
    below a tie (0.0015 is stored as less) is not taken for one.
    """
    percent = share * 100.0
    big, small = percent * 16.0, percent * 4.0
    total = big + small
    lost = (big - (total - (total - big))) + (small - (total - big))
    half_up = F.floor((total + 1.0) / 2.0)
    just_below = (F.rint(total) == total) & (total % 2.0 == 1.0) & (lost < 0.0)
    tenths = half_up - F.when(just_below, 1).otherwise(0)
    return F.format_string("%d.%d%%", F.floor(tenths / 10), tenths % 10)
