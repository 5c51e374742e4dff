"""Content tables: deduplication, reference counts, transfer between archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blob_table(entries: DataFrame) -> DataFrame:
    """hash, size, refs and the first path of every content that entries refer to; null hashes are no content."""
    held = entries.where("hash is not null")
    return held.groupBy("hash", "size").agg(F.count("*").alias("refs"), F.min("path").alias("first_path"))


def merged_blobs(blobs: DataFrame, more: DataFrame) -> DataFrame:
    """Union of two blob tables: contents once, counts summed."""
    return blobs.select("hash", "size", "refs").unionByName(more.select("hash", "size", "refs")).groupBy("hash", "size").agg(F.sum("refs").alias("refs"))


def missing_in(source: DataFrame, target: DataFrame) -> DataFrame:
    """Blobs of source that target lacks; each once."""
    return source.dropDuplicates(["hash"]).join(target.select("hash"), "hash", "left_anti")


def referenced_from(target: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """Blobs that sources add to target, the first source that has one winning; no images come along."""
    ranked = None
    for i, s in enumerate(sources):
        s = s.select("hash", "size").withColumn("source", F.lit(i))
        ranked = s if ranked is None else ranked.unionByName(s)
    first = ranked.groupBy("hash").agg(F.min(F.struct("source", "size")).alias("f")).select("hash", "f.size", "f.source")
    return first.join(target.select("hash"), "hash", "left_anti")


def in_use(blobs: DataFrame, entries: DataFrame) -> DataFrame:
    """Blobs that some entry refers to; the others are pruned."""
    return blobs.join(entries.select("hash"), "hash", "left_semi")


def worth_hashing(files: DataFrame) -> DataFrame:
    """files(id, size) with early: whether another file has the same size, so that its content must be hashed now.

    Sizes are counted first and joined back: a frequent size is never gathered in one task.
    """
    several = files.groupBy("size").agg((F.count("*") > 1).alias("early"))
    return files.join(several, "size").select("id", "size", "early")


def merged_streams(streams: DataFrame) -> DataFrame:
    """Captured streams (hash, identity, path, size) that will be stored once: by hash where known, else by identity."""
    key = F.coalesce(F.col("hash"), F.concat(F.lit("id:"), F.col("identity").cast("string")))
    return streams.groupBy(key.alias("key")).agg(F.min("path").alias("path"), F.max("size").alias("size"), F.count("*").alias("refs"))


def resolved_hashes(streams: DataFrame, content: DataFrame) -> DataFrame:
    """Streams (id, identity, hash) with pending hashes filled in: each shared identity is hashed once from content(identity, bytes)."""
    pending = streams.where("hash is null").select("identity").distinct()
    fresh = content.join(pending, "identity", "left_semi").groupBy("identity").agg(F.first(F.sha1("bytes")).alias("fresh"))
    return streams.join(fresh, "identity", "left").select("id", "identity", F.coalesce("hash", "fresh").alias("hash"))


def source_parts(blobs: DataFrame) -> DataFrame:
    """Distinct origins of blobs, one at least."""
    return blobs.agg(F.greatest(F.count_distinct("origin"), F.lit(1)).cast("long").alias("parts"))


def remaining_uses(blobs: DataFrame) -> DataFrame:
    """Blobs (file, ordinal) with the uses of their file that follow; at 0 the file is done with."""
    from pyspark.sql import Window

    after = Window.partitionBy("file").orderBy(F.desc("ordinal"))
    return blobs.withColumn("left", F.row_number().over(after).cast("long") - 1)


def byte_range(content: DataFrame, start: int, end: int) -> DataFrame:
    """Bytes [start, end) of each content; the digest is not checked, a range beyond the content is refused by a null."""
    fits = (F.lit(start) <= end) & (F.length("bytes") >= end)
    return content.select("hash", F.when(fits, F.substring("bytes", start + 1, end - start)).alias("part"))
