"""Verification and incremental reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.errors import ArchiveError

#: Fixed size of a header, which integrity chunks leave out, and the usual chunk.
HEADER, CHUNK = 208, 10 * 1024 * 1024


def missing_content(entries: DataFrame, blobs: DataFrame, strict: bool = False) -> DataFrame:
    """Entries whose content no blob holds."""
    lost = entries.where("hash is not null").join(blobs.select("hash"), "hash", "left_anti")
    if strict and (first := lost.first()) is not None:
        raise ArchiveError("resource_not_found", first["hash"])
    return lost


def corrupt_content(content: DataFrame, strict: bool = False) -> DataFrame:
    """Contents whose bytes do not have their digest."""
    bad = content.select("hash", F.sha1("bytes").alias("actual")).where("hash <> actual")
    if strict and (first := bad.first()) is not None:
        raise ArchiveError("invalid_resource_hash", first["hash"])
    return bad


def recovered(content: DataFrame) -> DataFrame:
    """Content with corrupt bytes kept and marked instead of refused."""
    return content.withColumn("recovered", F.sha1("bytes") != F.col("hash"))


def integrity_chunks(files: DataFrame, chunk: int = CHUNK, skip: int = HEADER) -> DataFrame:
    """file, idx, length and digest of consecutive chunks of files(file, bytes) after their header."""
    n = F.ceil((F.length("bytes") - skip) / chunk).cast("int")
    some = files.where(F.length("bytes") > skip).select("file", "bytes", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    part = F.substring(F.col("bytes"), F.col("idx") * chunk + skip + 1, F.lit(chunk))
    return some.select("file", "idx", F.length(part).cast("long").alias("length"), F.sha1(part).alias("digest"))


def integrity_status(files: DataFrame, stored: DataFrame, chunk: int = CHUNK, skip: int = HEADER) -> DataFrame:
    """Per file: ok, mismatch (with the first bad chunk) or nonexistent (no stored table)."""
    now = integrity_chunks(files, chunk, skip)
    both = now.select("file", "idx", F.col("digest").alias("now")).join(stored.select("file", "idx", F.col("digest").alias("then")), ["file", "idx"], "full")
    bad = both.groupBy("file").agg(F.min(F.when(~F.col("now").eqNullSafe(F.col("then")), F.col("idx"))).alias("first_bad"), F.max(F.col("then").isNotNull()).alias("has"))
    return files.select("file").join(bad, "file", "left").select(
        "file", F.when(~F.coalesce("has", F.lit(False)), "nonexistent").when(F.col("first_bad").isNull(), "ok").otherwise("mismatch").alias("status"),
        F.when(F.coalesce("has", F.lit(False)), F.col("first_bad")).alias("first_bad"),
    )


def reused_chunks(sizes: DataFrame, stored: DataFrame, chunk: int = CHUNK, skip: int = HEADER) -> DataFrame:
    """Chunks of files(file, size) after an append: a stored digest is kept where its chunk has the same length, else it is null and to be computed."""
    n = F.ceil((F.col("size") - skip) / chunk).cast("int")
    now = sizes.where(F.col("size") > skip).select("file", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"), "size")
    length = F.least(F.lit(chunk), F.col("size") - skip - F.col("idx") * chunk).cast("long")
    then = stored.select("file", "idx", F.col("length").alias("old"), "digest")
    return now.select("file", "idx", length.alias("length")).join(then, ["file", "idx"], "left").select("file", "idx", "length", F.when(F.col("old") == F.col("length"), F.col("digest")).alias("digest"))


def reused_digests(entries: DataFrame, template: DataFrame) -> DataFrame:
    """entries(path, created, written, accessed, reparse, streams) with what a template allows: its digests where path,
    creation, last write and kind are equal, the last access is not earlier, and every stream has its name and size there.

    streams is array<struct<name, size, hash>>; reused tells whether the digests were taken over.
    """
    t = template.select("path", *[F.col(c).alias("t_" + c) for c in ("created", "written", "accessed", "reparse", "streams")])
    both = entries.join(t, "path", "left")
    named = lambda s: F.struct(s["name"].alias("name"), s["size"].alias("size"))
    have, want = F.transform("t_streams", named), F.transform("streams", named)
    fits = (
        (F.col("created") == F.col("t_created")) & (F.col("written") == F.col("t_written")) & (F.col("accessed") >= F.col("t_accessed"))
        & (F.col("reparse") == F.col("t_reparse")) & (F.size(F.array_except(want, have)) == 0)
    )
    return both.select("path", F.coalesce(fits, F.lit(False)).alias("reused"), F.when(fits, F.col("t_streams")).otherwise(F.col("streams")).alias("streams"))


def manifest_faults(nodes: DataFrame) -> DataFrame:
    """Rule and node of every breach in a manifest (node, parent, name, is_dir, encrypted, file_id, content)."""
    siblings = nodes.groupBy("parent", F.upper("name").alias("folded")).agg(F.count("*").alias("n"), F.max("node").alias("node")).where("n > 1 and parent is not null").select(F.lit("sibling_names").alias("rule"), "node")
    parents = nodes.select(F.col("node").alias("parent"), F.col("is_dir").alias("parent_dir"))
    placed = nodes.where("parent is not null").join(parents, "parent", "left")
    order = placed.where(~F.coalesce((F.col("parent") < F.col("node")) & F.col("parent_dir"), F.lit(False))).select(F.lit("parent").alias("rule"), "node")
    alias = nodes.where("file_id is not null").groupBy("file_id").agg(F.count_distinct(F.struct("content", "encrypted")).alias("n"), F.max("node").alias("node")).where("n > 1").select(F.lit("alias_streams").alias("rule"), "node")
    hidden = nodes.where("encrypted").select(F.lit("encrypted").alias("rule"), "node")
    return siblings.unionByName(order).unionByName(alias).unionByName(hidden)


def concurrent_changes(captured: DataFrame, now: DataFrame, strict: bool = False) -> DataFrame:
    """Captured files (path, hash, size) that are gone or hold something else by now; refused if strict."""
    seen = now.select("path", F.col("hash").alias("hash_now"), F.col("size").alias("size_now"))
    changed = captured.select("path", "hash", "size").join(seen, "path", "left").where(~(F.col("hash").eqNullSafe(F.col("hash_now")) & F.col("size").eqNullSafe(F.col("size_now"))))
    if strict and (bad := changed.first()) is not None:
        raise ArchiveError("concurrent_modification", bad["path"])
    return changed
