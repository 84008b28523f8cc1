"""What a monitor does at each of its ticks: scans of trips that leave soon, alerts, and the final word before departure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monitored(trips: DataFrame, scans: DataFrame, ticks: DataFrame, window_min: int = 60, clear_min: int = 10, alert_min: float = 5.0) -> DataFrame:
    """(tick, trip, sent): scan (a trip that leaves within the window and is fine), alert, or all_clear, once for each trip.

    trips (trip, status, departure); scans (trip, at, should_alert, delay): what scans of trips say, each seen at the tick it was made for; ticks (tick), every 15 minutes.
    The final word goes out at the first tick five to ten minutes before departure, if the last scan of the 20 minutes before didn't alert.
    """
    active = trips.filter("status = 'active'").select("trip", "departure")
    ahead = F.unix_seconds("departure") - F.unix_seconds("tick")
    # a tick meets the trips of its hour and the next, not all
    hour = lambda c: F.floor(F.unix_seconds(c) / 3600)
    by_hour = active.withColumn("h", hour("departure"))
    near = ticks.withColumn("h", F.explode(F.array(hour("tick"), hour("tick") + 1))).join(by_hour, "h").drop("h")
    due = near.filter((ahead >= 0) & (ahead <= window_min * 60))
    now = scans.select(F.col("trip").alias("st"), F.col("at").alias("sat"), "should_alert", "delay")
    seen = due.join(now, (F.col("trip") == F.col("st")) & (F.col("tick") == F.col("sat")))
    told = seen.select("tick", "trip", F.when(F.col("should_alert") & (F.col("delay") >= alert_min), "alert").otherwise("scan").alias("sent"))
    last = near.filter((ahead >= (clear_min - 5) * 60) & (ahead <= clear_min * 60))
    recent = last.join(now, (F.col("trip") == F.col("st")) & (F.col("sat") <= F.col("tick")) & (F.col("sat") >= F.col("tick") - F.expr("INTERVAL 20 MINUTES")), "left")
    fine = recent.groupBy("tick", "trip").agg(F.max_by("should_alert", "sat").alias("alerted")).filter(~F.coalesce("alerted", F.lit(False)))
    once = fine.withColumn("n", F.row_number().over(Window.partitionBy("trip").orderBy("tick"))).filter("n = 1")
    return told.union(once.select("tick", "trip", F.lit("all_clear").alias("sent")))
