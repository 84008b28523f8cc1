"""Operators over traffic readings: history, blends, apportionment, as-of joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masar.functions import levels as L


def from_events(events: DataFrame) -> DataFrame:
    """Events as readings of a junction: jam (0 to 10), current and free speed, hour and weekday (Monday 0)."""
    value = F.col("value")
    order = [c for c in events.columns if c == "at"]
    return events.select(*order, "event_id", F.col("user_id").alias("junction"), "ts", "event_type", "value", (value - 10 * F.floor(value / 10)).alias("jam10"), (20 + (value - 40 * F.floor(value / 40))).alias("cur"), F.lit(60.0).alias("free"), F.hour("ts").alias("hour"), F.weekday("ts").alias("dow"))


def congestion_ratio(cur: Column, free: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - cur / free)


def speed_ratio(cur: Column, free: Column) -> Column:
    return F.when(free <= 0, 1.0).otherwise(cur / free)


def mean_in_order(value: Column, *keys: str) -> Column:
    """The mean of each row's group, added up from the group's first row to its last by ``at``: the same on every run, however the rows are dealt."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def rounded(x: Column, digits: int) -> Column:
    """Halves away from zero, of the double times the power of ten; Spark's own rounds the number as it is printed."""
    y = F.abs(x * 10.0**digits)
    return F.signum(x) * (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)) / 10.0**digits


def history(readings: DataFrame) -> DataFrame:
    """Mean jam (0 to 1) of each junction, hour and weekday."""
    return readings.groupBy("junction", "hour", "dow").agg(F.avg(F.col("jam10") / 10).alias("jam01"))


def with_history(rows: DataFrame, hist: DataFrame, default: float = 0.0) -> DataFrame:
    return rows.join(hist, ["junction", "hour", "dow"], "left").withColumn("jam01", F.coalesce("jam01", F.lit(default)))


def latest(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The last n readings of each key; Spark keeps n rows for each key before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n)


def ema(rows: DataFrame, key: str, n: int = 12, alpha: float = 0.3) -> DataFrame:
    """An exponential mean over the last n readings from the newest to the oldest, seeded with the newest."""
    lists = latest(rows, key, n).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "jam10"))).alias("js"))
    value = F.aggregate(F.slice("js", 2, n), F.get("js", F.lit(0))["jam10"], lambda a, x: alpha * x["jam10"] + (1 - alpha) * a)
    confidence = F.when(F.size("js") >= 12, 0.80).when(F.size("js") >= 6, 0.65).otherwise(0.45)
    return lists.select(key, value.alias("ema"), confidence.alias("confidence"))


def ensemble(historical: Column, seasonal: Column, recent: Column, upstream: Column) -> Column:
    """Weighted patterns, mixed with the upstream mean; without patterns the upstream mean, without any 0."""
    base = L.weighted((0.35, historical), (0.30, seasonal), (0.35, recent))
    mixed = F.when(upstream.isNull(), base).otherwise(0.60 * base + 0.40 * upstream)
    return F.when(base.isNull(), F.coalesce(upstream, F.lit(0.0))).otherwise(F.greatest(F.lit(0.0), mixed))


def proximity_mean(rows: DataFrame, keys: Sequence[str], value: str, lead: str, out: str) -> DataFrame:
    """The mean of the values, each weighing 1 / (lead + 1)."""
    return rows.groupBy(*keys).agg((F.sum(F.col(value) / (F.col(lead) + 1)) / F.sum(1 / (F.col(lead) + 1))).alias(out))


def recentred(rows: DataFrame, key: str, value: str, anchor: str) -> DataFrame:
    """Moves a key's values up to the anchor (9 at most) and triples their differences; never down."""
    mean, target = F.avg(value).over(Window.partitionBy(key)), F.least(F.col(anchor), F.lit(9.0))
    return rows.withColumn("__m", mean).withColumn(value, F.when(target > F.col("__m"), L.clamp(target + (F.col(value) - F.col("__m")) * 3, 0.0, 10.0)).otherwise(F.col(value))).drop("__m")


def apportion(rows: DataFrame, key: str, value: str, tie: str, total: int, worst: int = 3) -> DataFrame:
    """Deals a whole number of minutes to the worst few of each key, by largest remainders, so that they sum to it exactly."""
    top = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), tie))).filter(F.col("__n") <= worst)
    by = Window.partitionBy(key)
    raw = top.withColumn("__raw", total * F.col(value) / F.sum(value).over(by)).withColumn("__whole", F.floor("__raw").cast("int"))
    ranked = raw.withColumn("__rest", total - F.sum("__whole").over(by)).withColumn("__k", F.row_number().over(by.orderBy(F.desc("__raw"), "__n")))
    return ranked.withColumn("delay_min", (F.col("__whole") + F.when(F.col("__k") <= F.col("__rest"), 1).otherwise(0)).cast("int")).drop("__n", "__raw", "__whole", "__rest", "__k")


def collect_decision(events: DataFrame, recent_from: str, day_from: str, enough: int) -> DataFrame:
    """For each junction: skipped (enough recent readings), no_data, validated (near its mean) or collected."""
    at = lambda s: F.col("ts") >= F.lit(s).cast("timestamp")
    a = events.groupBy(F.col("user_id").alias("junction")).agg(F.count_if(at(recent_from)).alias("recent"), F.count_if(at(day_from)).alias("day"), F.avg("value").alias("mean"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))
    return a.withColumn("decision", F.when(F.col("recent") >= enough, "skipped").when(F.col("day") == 0, "no_data").when(F.abs(F.col("last") - F.col("mean")) <= 0.2 * F.col("mean"), "validated").otherwise("collected"))


def asof(left: DataFrame, right: DataFrame, key: str, time: str, value: str, max_age_s: int) -> DataFrame:
    """Left rows with the value of the right row of their key that is the latest at their time and younger than the age."""
    sided = left.withColumn("__side", F.lit(1)).unionByName(right.select(key, time, value, F.lit(0).alias("__side")), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(time, "__side", value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("__side") == 0, F.struct(time, value)), ignorenulls=True).over(order)
    young = F.unix_micros("__last." + time) > F.unix_micros(time) - max_age_s * 1_000_000
    return sided.withColumn("__last", last).filter("__side = 1").withColumn(value, F.when(young, F.col("__last." + value))).drop("__side", "__last")


def features(jam10: Column, cur: Column, ratio: Column, reduction: Column, delay: Column, confidence: Column, ts: Column, ways: Column, tier: Column, daily: Column, weekly: Column) -> Column:
    """The sixteen inputs of the short-horizon model; daily (96 quarters) and weekly (7 days) are a junction's seasons, null without any."""
    hour, dow = F.hour(ts), F.weekday(ts)
    turn = lambda x, n: F.lit(2 * math.pi) * x / n
    flag = lambda c: c.cast("double")
    or_ = lambda c, x: F.coalesce(c.cast("double"), F.lit(x))
    season = lambda values, at: F.coalesce(F.get(values, at), F.lit(0.0))
    return F.array(
        or_(jam10, 0.0) / 10, or_(cur, 30.0), or_(ratio, 1.0), or_(reduction, 0.0), or_(delay, 0.0), or_(confidence, 0.8), F.sin(turn(hour, 24)), F.cos(turn(hour, 24)), F.sin(turn(dow, 7)), F.cos(turn(dow, 7)),
        flag(dow.isin(4, 5)), flag(dow == 4), or_(ways, 3.0), or_(tier, 1.0), season(daily, hour * 4 + F.floor(F.minute(ts) / 15).cast("int")), season(weekly, dow),
    )


def seasons(readings: DataFrame) -> DataFrame:
    """(junction, daily, weekly): the mean jam (0 to 1) of each quarter of an hour and of each weekday, 0 where there is none; readings have their order (at)."""
    rows = readings.select("at", "junction", (F.col("jam10") / 10).alias("v"), (F.hour("ts") * 4 + F.floor(F.minute("ts") / 15)).cast("int").alias("q"), F.weekday("ts").alias("d"))
    means = lambda by, n, name: rows.withColumn("m", mean_in_order(F.col("v"), "junction", by)).groupBy("junction", by).agg(F.first("m").alias("m")).groupBy("junction").agg(F.map_from_entries(F.collect_list(F.struct(by, "m"))).alias("x")).select("junction", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("x", k), F.lit(0.0))).alias(name))
    return means("q", 96, "daily").join(means("d", 7, "weekly"), "junction")


def decayed(hist: Column, current: Column, minutes: Column) -> Column:
    """The current jam falls to the usual one within an hour."""
    return hist + (current - hist) * F.greatest(F.lit(0.0), 1 - minutes / 60.0)


def verdict(live: Column, usual: Column, margin: float = 0.12) -> Column:
    return F.when(live > usual + margin, "worse").when(live < usual - margin, "better").otherwise("normal")


def first_source(parts: Sequence[tuple[str, Column]], last: str, default: float) -> tuple[Column, Column]:
    """The first value that isn't null, and its source's name."""
    name = F.when(parts[0][1].isNotNull(), parts[0][0])
    for label, value in parts[1:]:
        name = name.when(value.isNotNull(), label)
    return F.coalesce(*(v for _, v in parts), F.lit(default)), name.otherwise(last)
