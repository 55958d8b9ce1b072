"""Tables written between steps, for what is read more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir``, so that it is computed once and outlives lost executors.

    A local session without that setting uses a temporary folder; on a cluster it must be set.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="barloom-"))
    return df.checkpoint()
