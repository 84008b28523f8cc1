"""Sinks: appends, partition rewrites, upserts by rewriting, idempotent chunks, line streams."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("append").partitionBy(*by).parquet(path)


def rewrite_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Replaces only the partitions that the rows belong to, so a chunk may be written again after a failure."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the cluster's shared folder; on one machine, where none is set, in a folder of our own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    return f"{(root or 'file://' + tempfile.gettempdir()).rstrip('/')}/masar-{label}-{uuid.uuid4().hex[:12]}"


def resumed(rows: DataFrame, path: str, chunk: str) -> DataFrame:
    """Imports the chunks that the table at ``path`` hasn't got, and returns the table: a job that broke off goes on where it stopped.

    A chunk is a partition, and appears as a whole or not at all.
    """
    spark = rows.sparkSession
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        done = spark.read.parquet(path).select(F.col(chunk).alias("done_chunk")).distinct()
        rows = rows.join(done, F.col(chunk) == F.col("done_chunk"), "left_anti")
    rewrite_partitions(rows, path, chunk)
    return spark.read.parquet(path)


def merged(path: str, old: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Writes the latest version of each key beside the old table, as a new version of it, and reads that back."""
    upserted(old, changes, key, order).write.mode("errorifexists").parquet(path)
    return old.sparkSession.read.parquet(path)


def notified(alerts: DataFrame, tokens: DataFrame, user: str, path: str, send: Callable[[str, str], bool] | None = None) -> DataFrame:
    """Sends each alert (user, text) to each of the user's tokens and keeps what came of it: (user, token, text, sent), written and read back.

    Without a sender everything is kept as unsent, for another process to send.
    """
    asked = alerts.join(tokens, user).select(user, "token", "text")
    if send is None:
        out = asked.withColumn("sent", F.lit(False))
    else:
        deliver = F.pandas_udf(lambda t, x: pd.Series([bool(send(a, b)) for a, b in zip(t, x, strict=True)]), "boolean")
        out = asked.withColumn("sent", deliver("token", "text"))
    out.write.mode("append").parquet(path)
    return alerts.sparkSession.read.parquet(path)


def replaced(rows: DataFrame, path: str) -> DataFrame:
    """Replaces a small state table as a whole: readers see the old one or the new one, and what can't be read counts as none."""
    rows.coalesce(1).write.mode("overwrite").json(path)
    return rows.sparkSession.read.schema(rows.schema).option("mode", "DROPMALFORMED").json(path)


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The latest version of each key of both; the new row wins at equal order."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("__new")))
    return both.withColumn("__n", n).filter("__n = 1").drop("__n", "__new")


def lines(rows: DataFrame, kind: str) -> DataFrame:
    """Typed JSON lines."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), *rows.columns)).alias("value"))


def write_lines(rows: DataFrame, kind: str, path: str) -> None:
    lines(rows, kind).write.mode("append").text(path)
