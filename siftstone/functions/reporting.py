"""Formatting and step schedules as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(value: Column, places: int | None = 2) -> Column:
    """Fixed places; none: whole number, cut towards zero; NA for null, NaN and infinite values."""
    bad = value.isNull() | F.isnan(value.cast("double")) | (F.abs(value.cast("double")) == float("inf"))
    text = value.cast("long").cast("string") if places is None else F.format_string(f"%.{places}f", value.cast("double"))
    return F.when(bad, "NA").otherwise(text)


def colour(value: Column, good: float, bad: float, down: bool = True) -> Column:
    """green within good, red beyond bad, black between; gray without a value."""
    ok, wrong = (value <= good, value > bad) if down else (value >= good, value < bad)
    return F.when(value.isNull() | F.isnan(value.cast("double")), "gray").when(ok, "green").when(wrong, "red").otherwise("black")


#: Least and greatest good value of each parameter, and which side counts: both, only the least one (high is good), or only the greatest one (low is good) (fixed values).
PARAMETER_RANGES = {
    "MW": (200, 450, "both"), "LogP": (2, 4, "both"), "TPSA": (40, 90, "both"), "HBD": (0, 2, "both"), "HBA": (2, 6, "both"), "RotB": (0, 8, "both"), "RingCount": (3, 5, "both"), "CNS_MPO": (4, 6, "high"), "QED": (0.35, 1.0, "high"),
    "LE": (0.3, 1.0, "high"), "LLE": (5, 10, "high"), "docking_score": (-10, -7, "low"), "logBB_est": (-1, 1, "high"), "bbb_prob": (0.7, 1.0, "high"),
}


def parameter_colour(value: Column, parameter: str) -> Column:
    """green for a good value, red for another one, gray for null or NaN; black for a parameter without a range."""
    missing = value.isNull() | F.isnan(value.cast("double"))
    if parameter not in PARAMETER_RANGES:
        return F.when(missing, "gray").otherwise("black")
    low, high, side = PARAMETER_RANGES[parameter]
    good = {"both": value.between(low, high), "high": value >= low, "low": value <= high}[side]
    return F.when(missing, "gray").when(good, "green").otherwise("red")


def cyclical(step: Column, total: int, cycles: int = 4, ratio: float = 0.5, top: float = 1.0) -> Column:
    """In each cycle a line up to top within ratio of it, then top."""
    period = total / cycles
    place = (step - F.floor(step / period) * period) / period
    return F.least(place / ratio, F.lit(1.0)) * top


def monotonic(step: Column, total: int, warm: float = 0.5, top: float = 1.0) -> Column:
    return F.least(step / (total * warm), F.lit(1.0)) * top


def sigmoid(step: Column, total: int, slope: float = 10.0, top: float = 1.0) -> Column:
    return F.lit(top) / (F.exp((step / total - 0.5) * -slope) + 1.0)


def after_warmup(step: Column, total: int, warm: int = 1000, top: float = 1.0) -> Column:
    """0 before step warm, from there a line up to top at step total."""
    return F.when(step < warm, 0.0).otherwise(F.least((step - warm) / (total - warm), F.lit(1.0)) * top)


def rising(step: Column, total: int, slope: float = 0.0025, top: float = 1.0) -> Column:
    """A logistic curve by steps, half of top at a quarter of total."""
    return F.lit(top) / (F.exp((step - total * 0.25) * -slope) + 1.0)


def histogram_bucket(value: Column, low: float, high: float, buckets: int) -> Column:
    """Bucket 0 to buckets - 1 of equal width, the last one closed; values outside go to the ends."""
    width = (high - low) / buckets
    return F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((value - low) / width))).cast("int") if width and math.isfinite(width) else F.lit(0)
