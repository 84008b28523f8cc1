"""Cutting the lineage of a table, so that plans stay small and lost executors cost one step at most."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The table written to the cluster's checkpoint folder; on one machine, where none is set, to a folder of our own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="masar-"))
    return df.checkpoint()
