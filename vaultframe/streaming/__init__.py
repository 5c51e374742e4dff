"""Sequential archives as streams: frames arrive in order, parts follow each other, wanted contents are collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "seq long, kind string, part int, hash string, bytes binary, at timestamp"


def frames(spark: SparkSession, folder: str, per_trigger: int = 8) -> DataFrame:
    """Frames from parquet files as they arrive: blob frames with their content, part frames that only mark a boundary."""
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def wanted_frames(stream: DataFrame, wanted: DataFrame, recover: bool = False, delay: str = "1 hour") -> DataFrame:
    """Blob frames whose hash is wanted, each content once; others are skipped without looking at their bytes.

    A frame whose bytes do not have its digest is left out, or kept and marked if recover is set.
    """
    hits = stream.where("kind = 'blob'").join(wanted.select("hash").distinct(), "hash")
    hits = hits.withColumn("sound", F.sha1("bytes") == F.col("hash"))
    hits = hits if recover else hits.where("sound")
    return hits.withWatermark("at", delay).dropDuplicatesWithinWatermark(["hash"]).select("seq", "hash", F.length("bytes").cast("long").alias("size"), "sound")


def progress(stream: DataFrame, delay: str = "1 hour", window: str = "1 minute") -> DataFrame:
    """Progress events: frames and bytes seen per window of event time."""
    return (
        stream.where("kind = 'blob'").withWatermark("at", delay).groupBy(F.window("at", window)).agg(F.count("*").alias("frames"), F.sum(F.length("bytes")).cast("long").alias("bytes"))
        .select(F.col("window.start").alias("start"), "frames", "bytes")
    )


def parts_seen(stream: DataFrame) -> DataFrame:
    """Per part: contents and bytes so far, its first and last place, and whether its boundary frame has come. One state row per part."""
    blob = F.col("kind") == "blob"
    return stream.groupBy("part").agg(
        F.sum(F.when(blob, 1).otherwise(0)).alias("contents"), F.coalesce(F.sum(F.when(blob, F.length("bytes"))), F.lit(0)).cast("long").alias("bytes"),
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.max(F.col("kind") == "part").alias("begun"),
    )


def outstanding(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Wanted contents that have not come: empty when the extraction is complete."""
    return wanted.select("hash").distinct().join(done.select("hash"), "hash", "left_anti")
