"""Row rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadweave import constants as C

_NUMBER = r"^\s*[+-]?(\d+|\d*\.\d+|\d+\.)([eE][+-]?\d+)?\s*$"


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def tolerant_int(text: Column, default: int = 0) -> Column:
    """Whole number from text; anything else becomes ``default``."""
    return F.coalesce(text.try_cast("int"), F.lit(default))


def _km_part_in_range(vd_id: Column) -> Column:
    def hit(part: Column) -> Column:
        return part.rlike(_NUMBER) & part.try_cast("double").between(
            C.ROUTE_KM_LOW, C.ROUTE_KM_HIGH
        )

    return F.exists(F.split(vd_id, "-"), hit)


def is_target_route(vd_id: Column, strict: bool = False) -> Column:
    """Detector lies on the target route.

    The default keeps the established substring rule, which also accepts ids
    such as ``…N1-N-200…`` and ``N10``. ``strict`` wants the whole token ``N1``
    and a kilometre part between 20 and 30 (or one of the place names).
    """
    if strict:
        named = any_of([vd_id.contains(k) for k in C.ROUTE_KEYWORDS[:3]])
        on_n1 = F.array_contains(F.split(vd_id, "-"), "N1")
    else:
        named = any_of([vd_id.contains(k) for k in C.ROUTE_KEYWORDS])
        on_n1 = vd_id.contains("N1")
    return F.coalesce(named | (on_n1 & _km_part_in_range(vd_id)), F.lit(False))


def is_vd_file(name: Column) -> Column:
    lowered = F.lower(name)
    return any_of([lowered.contains(k) for k in C.VD_FILE_KEYWORDS])


def original_name(archived: Column) -> Column:
    """File name before archiving put ``YYYYMMDD_HHMMSS_`` in front of it."""
    rest = F.regexp_extract(archived, r"^[^_]*_[^_]*_(.*)$", 1)
    return F.when(archived.rlike(r"^[^_]*_[^_]*_"), rest).otherwise(archived)


def vehicle_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in C.VEHICLE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code), F.concat(F.lit("未知("), code, F.lit(")")))


def travel_minutes(seconds: Column) -> Column:
    return F.when(seconds > 0, F.round(seconds / F.lit(60.0), 2)).otherwise(F.lit(0.0))


def flow_is_valid(travel: Column, count: Column) -> Column:
    return F.coalesce(((travel > 0) & (count > 0)).cast("int"), F.lit(0))


def traffic_status(speed: Column) -> Column:
    return F.when(speed >= 80, "暢通🟢").when(speed >= 50, "緩慢🟡").otherwise("擁堵🔴")


def scenario_state(speed: Column) -> Column:
    return (
        F.when(speed < 30, "嚴重擁堵")
        .when(speed < 50, "擁堵")
        .when(speed < 70, "順暢")
        .otherwise("非常順暢")
    )


def r2_band(r2: Column) -> Column:
    return (
        F.when(r2 > 0.8, "excellent")
        .when(r2 > 0.7, "good")
        .when(r2 > 0.5, "acceptable")
        .otherwise("insufficient")
    )


def tuning_band(r2: Column) -> Column:
    """The stricter scale that tuned models are judged by."""
    return F.when(r2 > 0.9, "excellent").when(r2 > 0.8, "good").otherwise("needs work")


def accuracy_band(r2: Column, accuracy_rate: Column) -> Column:
    return (
        F.when((r2 > 0.8) & (accuracy_rate > 80), "excellent")
        .when((r2 > 0.7) & (accuracy_rate > 70), "good")
        .otherwise("needs work")
    )


def latency_band(millis: Column) -> Column:
    return (
        F.when(millis < 50, "excellent").when(millis < 100, "good").otherwise("needs work")
    )


def accuracy_midpoint(text: Column, default: float = 75.0) -> Column:
    """Middle of a range written like ``85-92%``."""
    parts = F.split(F.replace(text, F.lit("%"), F.lit("")), "-")
    low = F.try_element_at(parts, F.lit(1)).try_cast("int")
    high = F.try_element_at(parts, F.lit(2)).try_cast("int")
    return F.coalesce((low + high) / F.lit(2.0), F.lit(default))


def speed_level(speed: Column) -> Column:
    """Right-closed levels (0,40] (40,60] (60,80] (80,120]; null elsewhere."""
    return (
        F.when((speed > 0) & (speed <= 40), 1.0)
        .when((speed > 40) & (speed <= 60), 2.0)
        .when((speed > 60) & (speed <= 80), 3.0)
        .when((speed > 80) & (speed <= 120), 4.0)
    )


def congestion(speed: Column) -> Column:
    return F.when(
        speed.isNotNull(), F.greatest(F.least(F.lit(100.0) - speed, F.lit(100.0)), F.lit(0.0)) / 100.0
    )
