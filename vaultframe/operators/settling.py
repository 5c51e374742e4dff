"""Lineage cuts for iterative operators."""

import re
import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder of spark.checkpoint.dir; only on one machine a folder of our own where the session names none."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()
