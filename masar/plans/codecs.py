"""Codecs, inference and sinks over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masar.functions import codecs as C
from masar.operators import neural as N
from masar.plans.geometry import PTS, points
from masar.plans.registry import query, table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's points as one line, in order."""
    p = points(spark, sf_dir).groupBy("route").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lng"))).alias("ps"))
    return p.select("route", F.transform("ps", lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lng"))).alias("ps"))


_LINE = f"SELECT route, count(*) AS n, round(sum(lat), 4) AS lat, round(sum(lng), 4) AS lng FROM {PTS} GROUP BY route"


def _round_trip(spark: SparkSession, sf_dir: str, precision: int) -> DataFrame:
    back = _lines(spark, sf_dir).select("route", C.decode_polyline(C.encode_polyline("ps", precision), precision).alias("ps"))
    total = lambda name: F.round(F.aggregate("ps", F.lit(0.0), lambda a, p: a + p[name]), 4)
    return back.select("route", F.size("ps").cast("long").alias("n"), total("lat").alias("lat"), total("lng").alias("lng"))


@query("fn_poly5_dec", _LINE)
def polyline5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, 5)


@query("fn_poly6_dec", _LINE)
def polyline6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, 6)


@query("fn_poly5_enc")
def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("route", C.encode_polyline("ps").alias("line"))


@query("src_wav", "SELECT doc_id, strlen(text)/16000.0::DOUBLE AS seconds FROM documents")
def wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts wrapped as one-channel 8-bit audio at 16 kHz, measured from their headers."""
    n = F.octet_length("text")
    four = lambda x: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4))))
    fmt = bytes.fromhex("666d7420") + bytes([16, 0, 0, 0, 1, 0, 1, 0]) + (16_000).to_bytes(4, "little") * 2 + bytes([1, 0, 8, 0])
    riff = F.concat(F.lit(b"RIFF"), four(n + 36), F.lit(b"WAVE"), F.lit(fmt), F.lit(b"data"), four(n), F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", C.wav_duration(riff).alias("seconds"))


@query("fn_matmul_gcn_lstm")
def inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of 64 numbers repeated to a window of 12 steps and 16 features; eight neighbours are a graph, a ring; the weights are seeded."""
    window = F.flatten(F.array_repeat("embedding", 3))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 8).cast("long").alias("graph"), (F.col("vec_id") % 8).cast("int").alias("node"), window.alias("w"))
    ring = {(k, (k + s) % 8): 1.0 for k in range(8) for s in (1, 7)}
    p = N.predict_graphs(e, "graph", "node", "w", N.seeded(), ring, 8)
    return p.select((F.col("graph") * 8 + F.col("node")).alias("vec_id"), *(F.round(c, 6).alias(c) for c in ("jam_15", "jam_30", "jam_60", "congested")))
