"""Congestion scales: levels, multipliers and floors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the level tables.
TIER1 = ((0.2, "FREE"), (0.4, "LIGHT"), (0.6, "MODERATE"))
ROUTE = ((0.15, "FREE"), (0.32, "LIGHT"), (0.55, "MODERATE"), (0.80, "HIGH"))
JAM10 = ((8.0, "CRITICAL"), (5.5, "SERIOUS"), (3.2, "WARNING"), (1.5, "ADVISORY"))
ORDER = ("FREE", "ADVISORY", "WARNING", "SERIOUS", "CRITICAL")
CONGESTED = ("WARNING", "SERIOUS", "CRITICAL")
FLOORS = (("CRITICAL", 18, "SERIOUS"), ("SERIOUS", 10, "WARNING"), ("WARNING", 5, "ADVISORY"))


def _below(x: Column, steps: tuple, last: str) -> Column:
    out = F.when(x < steps[0][0], steps[0][1])
    for limit, name in steps[1:]:
        out = out.when(x < limit, name)
    return out.otherwise(last)


def level_tier1(jam01: Column) -> Column:
    return _below(jam01, TIER1, "HIGH")


def level_route(jam01: Column) -> Column:
    return _below(jam01, ROUTE, "VERY_HIGH")


def level_jam10(jam10: Column) -> Column:
    out = F.when(jam10 >= JAM10[0][0], JAM10[0][1])
    for limit, name in JAM10[1:]:
        out = out.when(jam10 >= limit, name)
    return out.otherwise("FREE")


def level_rank(level: Column) -> Column:
    out = F.lit(0)
    for k, name in enumerate(ORDER):
        out = F.when(level == name, k).otherwise(out)
    return out


def with_floors(level: Column, delay_min: Column) -> Column:
    """Each floor may demote once more what the one before it has demoted."""
    for name, least, lower in FLOORS:
        level = F.when((level == name) & (delay_min < least), lower).otherwise(level)
    return level


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def multiplier(jam01: Column) -> Column:
    return 1.0 + 1.5 * jam01


def buffer(jam01: Column) -> Column:
    return F.bround(1.0 + jam01 * 0.50, 3)


def jam_of_ratio(duration: Column, base: Column) -> Column:
    return F.bround(clamp((duration / F.greatest(base, F.lit(1)) - 1.0) / 1.5, 0.0, 1.0), 3)


def jam_adaptive(duration: Column, free: Column) -> Column:
    return F.bround(clamp((duration / F.greatest(free, F.lit(1)) - 1.0) / 0.50, 0.0, 1.0), 3)


def dow_boost(weekday: Column, hour: Column) -> Column:
    """Friday all day; Thursday in its rush hours (Monday is 0)."""
    rush = hour.between(7, 10) | hour.between(16, 20)
    return F.when(weekday == 4, 0.08).when((weekday == 3) & rush, 0.10).otherwise(0.0)


def weighted(*parts: tuple[float, Column]) -> Column:
    """The mean of what isn't null, weights made to add up to 1; null if all are."""
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in parts), F.lit(0.0))
    value = sum((F.coalesce(v * w, F.lit(0.0)) for w, v in parts), F.lit(0.0))
    return value / F.nullif(total, F.lit(0.0))
