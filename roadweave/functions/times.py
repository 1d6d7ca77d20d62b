"""Calendar columns. Three peak definitions exist side by side, so each is named."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadweave import constants as C


def _half_open(hour: Column, *spans: tuple[int, int]) -> Column:
    cond = F.lit(False)
    for low, high in spans:
        cond = cond | ((hour >= low) & (hour < high))
    return cond


def is_weekend(ts: Column) -> Column:
    return F.coalesce(F.weekday(ts) >= 5, F.lit(False))


def time_category(ts: Column) -> Column:
    """Four-way label: weekday 7-9 and 17-20, weekend 9-12 and 15-19, half open.

    A missing time counts as weekday off-peak.
    """
    hour = F.hour(ts)
    weekend = is_weekend(ts)
    return (
        F.when(weekend & _half_open(hour, (9, 12), (15, 19)), C.WEEKEND_PEAK)
        .when(weekend, C.WEEKEND_OFFPEAK)
        .when(_half_open(hour, (7, 9), (17, 20)), C.WEEKDAY_PEAK)
        .otherwise(C.WEEKDAY_OFFPEAK)
    )


def is_peak_label(category: Column) -> Column:
    return F.coalesce(category.contains("尖峰"), F.lit(False))


def flag(cond: Column) -> Column:
    return F.coalesce(cond.cast("int"), F.lit(0))


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * F.lit(2.0 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def fused_calendar(ts: Column) -> dict[str, Column]:
    """Calendar features of the fused table: closed peaks 7..9 and 17..19, every day."""
    hour, dow = F.hour(ts), F.weekday(ts)
    sin_h, cos_h = cyclic(hour, 24)
    morning, evening = hour.between(7, 9), hour.between(17, 19)
    return {
        "hour": hour,
        "day_of_week": dow,
        "is_weekend": flag(dow >= 5),
        "is_morning_peak": flag(morning),
        "is_evening_peak": flag(evening),
        "is_peak_hour": flag(morning | evening),
        "hour_sin": sin_h,
        "hour_cos": cos_h,
    }


def station_calendar(ts: Column) -> dict[str, Column]:
    """Calendar features of the station table: half-open peaks on weekdays only."""
    hour, minute, dow = F.hour(ts), F.minute(ts), F.weekday(ts)
    sin_h, cos_h = cyclic(hour, 24)
    sin_m, cos_m = cyclic(minute, 60)
    sin_d, cos_d = cyclic(dow, 7)
    workday = ~is_weekend(ts)
    morning = _half_open(hour, (7, 9)) & workday
    evening = _half_open(hour, (17, 20)) & workday
    return {
        "hour": hour,
        "minute": minute,
        "day_of_week": dow,
        "is_weekend": flag(dow >= 5),
        "hour_sin": sin_h,
        "hour_cos": cos_h,
        "minute_sin": sin_m,
        "minute_cos": cos_m,
        "day_sin": sin_d,
        "day_cos": cos_d,
        "is_morning_peak": flag(morning),
        "is_evening_peak": flag(evening),
        "is_peak_hour": flag(morning | evening),
    }


def floor_bin(ts: Column, minutes: int = C.BIN_MINUTES) -> Column:
    """Start of the ``minutes`` bin holding ``ts``, as a timestamp."""
    width = minutes * 60
    secs = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(secs - F.pmod(secs, F.lit(width)))

