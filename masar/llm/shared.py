"""The shared folder of the cluster, written tables that cut lineage, and sorted arrays that workers map into memory."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that every machine sees: ``spark.checkpoint.dir``, or on one machine (tests) a folder of our own where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="masar-shared-")
    return _OWN[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh URI under the shared folder."""
    return f"{shared_root(spark)}/masar-{label}-{uuid.uuid4().hex[:12]}"


def local_path(uri: str) -> str:
    """The path under which workers open a shared folder with plain file calls.

    Memory-mapped models need the shared folder to be mounted (``file:`` or no scheme), as the arrays are
    mapped in place and never copied to a worker's own disk.
    """
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped arrays need a mounted shared folder, not {uri}")
    return parsed.path


def array_folder(spark: SparkSession, label: str) -> str:
    """A fresh mounted folder for arrays."""
    path = local_path(new_folder(spark, label))
    os.makedirs(path, exist_ok=True)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: executors may be lost without losing it."""
    spark = df.sparkSession
    uri = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(uri)
    out = spark.read.schema(df.schema).parquet(uri)
    out._masar_uri = uri
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that ``materialize`` wrote, once nothing reads it any more."""
    uri = getattr(df, "_masar_uri", None)
    if uri:
        drop_uri(df.sparkSession, uri)


def drop_uri(spark: SparkSession, uri: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of ``df`` has it; Spark doesn't tell upper from lower case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def write_atomically(path: str, data: bytes) -> None:
    """A retried or doubled task leaves the same whole file."""
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
