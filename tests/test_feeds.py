"""Feeds and sinks: pages until a short one, retries, manifests, imports that go on, state that is replaced."""

import json

import pytest
from pyspark.sql import functions as F

from masar.sources import connectors, feeds, sinks


@pytest.mark.parametrize("step", [1, 3, 8])
def test_pages_until_a_short_one(spark, tmp_path, step):
    connectors.register(spark)
    for page, n in enumerate([10, 10, 10, 4]):
        (tmp_path / f"p{page}.json").write_text(json.dumps([{"id": 100 * page + k, "kind": "a" if k % 2 else "b"} for k in range(n)]))
    d = spark.read.format("paged_table").schema("id long, kind string").option("url", f"file://{tmp_path}/p{{page}}.json").option("size", 10).option("step", step).load()
    assert sorted(r["id"] for r in d.collect()) == [100 * p + k for p, n in enumerate([10, 10, 10, 4]) for k in range(n)]
    assert d.filter("kind = 'a'").count() == 17


def test_retries():
    calls, slept = [], []

    def fetch(k):
        calls.append(k)
        return (429, None) if len(calls) < 3 else (200, k)

    assert feeds.with_retries(fetch, sleep=slept.append)(7) == (7, 3, 2.5) and slept == [1.0, 1.5]
    assert feeds.with_retries(lambda: (429, None), sleep=slept.append)() == (None, 3, 2.5)
    assert feeds.with_retries(lambda: (500, "x"))() == (None, 1, 0.0)


def test_manifests(spark):
    entry = {"id": "a-1", "file": "f", "sha256": "0", "bbox": [1, 2, 3, 4], "places": 1}
    bodies = [{"national": entry, "tiles": [entry, entry | {"id": "../x"}, entry | {"bbox": [1]}, {}]}, {"national": entry | {"id": None}, "tiles": [entry]}, {"tiles": [entry]}, {"national": entry}]
    d = spark.createDataFrame([(k, json.dumps(b)) for k, b in enumerate(bodies)] + [(9, "not json"), (10, None)], "k int, m string")
    got = {r["k"]: r["t"] and [e["id"] for e in r["t"]] for r in d.select("k", feeds.tiles_of(F.col("m")).alias("t")).collect()}
    assert got == {0: ["a-1", "a-1"], 1: None, 2: None, 3: None, 9: None, 10: None}


def test_until_short_and_flows(spark):
    pages = spark.createDataFrame([(0, 10), (1, 10), (2, 7), (3, 10), (4, 1)], "page int, n int")
    assert sorted(r["page"] for r in feeds.until_short(pages, "page", "n", 10).collect()) == [0, 1, 2]
    assert feeds.until_short(pages.filter("page < 2"), "page", "n", 10).count() == 2 and feeds.until_short(pages.limit(0), "page", "n", 10).count() == 0
    bodies = ['{"flowSegmentData":{"currentSpeed":30,"freeFlowSpeed":60,"confidence":0.77}}', '{"flowSegmentData":{"currentSpeed":30,"freeFlowSpeed":0}}', '{"flowSegmentData":{"currentSpeed":9,"freeFlowSpeed":60,"roadClosure":true}}', "{}", None]
    d = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, b string")
    got = d.select("k", feeds.flow_reading(F.col("b")).alias("f"), feeds.precise_flow(F.col("b")).alias("p")).orderBy("k").collect()
    assert (got[0]["f"]["jam_factor"], got[0]["f"]["speed_reduction"], got[1]["f"]["congestion_ratio"]) == (5.0, 30.0, 1.0) and got[4]["f"] is None
    assert [r["p"] is not None for r in got] == [True, False, False, False, False]


def test_an_import_goes_on(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") / 10).cast("int").alias("chunk"))
    path = f"file://{tmp_path}/t"
    assert sinks.resumed(rows.filter("chunk < 3"), path, "chunk").count() == 30
    changed = rows.withColumn("id", F.col("id") + 1000)
    got = sorted(r["id"] for r in sinks.resumed(changed, path, "chunk").collect())
    assert got == [*range(30), *range(1030, 1100)]  # what was there stays


def test_state_that_cannot_be_read_is_none(spark, tmp_path):
    path = f"{tmp_path}/s"
    rows = spark.createDataFrame([(1, "a")], "tile long, file string")
    assert sinks.replaced(rows, path).collect() == [(1, "a")]
    (tmp_path / "s" / "part-broken.json").write_text("{broken")
    assert spark.read.schema(rows.schema).option("mode", "DROPMALFORMED").json(path).collect() == [(1, "a")]
