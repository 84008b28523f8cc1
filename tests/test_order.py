"""Means that decide are added up in the order of the files, as the SQL adds them on one thread."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from masar.operators import readings as R
from masar.plans import catalog


def test_mean_in_order(spark):
    r = random.Random(1)
    values = [round(r.uniform(0, 500), 2) for _ in range(4000)]
    total = 0.0
    for v in values:
        total += v
    d = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "at int, v double").repartition(7)
    assert d.select(R.mean_in_order(F.col("v")).alias("m")).distinct().collect() == [(total / len(values),)]


@pytest.mark.parametrize("name", ["agg_best_window", "agg_hist_avg_similar", "agg_traffic_verdict", "hist_lookup", "prj_feature16", "win_group_island"])
def test_as_one_thread_has_it(spark, tmp_path, name):
    r = random.Random(name)
    rows = [(k, 1704067200 + 900 * r.randrange(900), None if k % 50 == 0 else r.randrange(6), r.choice(["view", "click"]), round(r.uniform(0, 100), 2)) for k in range(1500)]
    rows += [(2000 + k, 1704067200, 77, "view", v) for k, v in enumerate([5.196875, 5.196875])]
    d = spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz"))
    d.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = catalog.queries()[name](spark, str(tmp_path))
    assert "row_index" in df._jdf.queryExecution().optimizedPlan().toString()
    c = duckdb.connect(config={"threads": 1})
    c.execute("SET timezone = 'UTC'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    columns = ", ".join(f'"{x}"' for x in df.columns)
    want = c.execute(f"SELECT {columns} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
