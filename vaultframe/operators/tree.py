"""Directory trees: listings, subtrees, links, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.functions import base_name, collation_key, depth, digest_bytes, digest_text, parent_path, within


def dir_entries(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """A listing row per entry: where it is, how many names its inode has, its content and whether that is missing.

    Hashes are most of what is shuffled here, so they are shuffled as bytes. Several rows of blobs may hold one hash; those without a size count as missing.
    """
    links = entries.groupBy("image", "inode").agg(F.count("*").alias("links"))
    held = blobs.where("size is not null").select(digest_bytes(F.col("hash")).alias("digest")).distinct().withColumn("held", F.lit(True))
    placed = entries.select("image", "path", "inode", "size", digest_bytes(F.col("hash")).alias("digest"))
    return placed.join(links, ["image", "inode"]).join(held, "digest", "left").select(
        "image", "path", base_name(F.col("path")).alias("name"), parent_path(F.col("path")).alias("parent"), depth(F.col("path")).alias("depth"),
        "links", digest_text(F.col("digest")).alias("hash"), "size", (F.col("digest").isNotNull() & F.col("held").isNull()).alias("missing"),
    )


def subtree(paths: DataFrame, root: str, recursive: bool = False, children: bool = False) -> DataFrame:
    """Rows at root; with recursive all below it too; with children its direct children instead of itself."""
    p, at = F.col("path"), F.lit(root)
    below = depth(p) - depth(at)
    if children:
        keep = within(p, at) & (below >= 1) & (F.lit(recursive) | (below == 1))
    else:
        keep = within(p, at) & (F.lit(recursive) | (below == 0))
    return paths.where(keep)


def hardlink_groups(entries: DataFrame) -> DataFrame:
    """path and canonical path (first in order) of each inode's names in an image; an inode with other content is another group."""
    first = entries.groupBy("image", "inode", "hash").agg(F.min("path").alias("canonical"), F.count("*").alias("names"))
    return entries.join(first, ["image", "inode", "hash"]).select("image", "path", "canonical", "names")


def canonical_counts(entries: DataFrame, streams: DataFrame) -> DataFrame:
    """hash and refs: each entry counts the contents of its canonical inode, so that an alias counts once more.

    entries(image, path, node, group_id, hash, is_dir), streams(image, node, hash) with a row per stream. Entries of one
    group (0 is none) and content are one inode, whose canonical entry is the first of the walk; directories never are.
    """
    grouped = (F.col("group_id") != 0) & ~F.col("is_dir")
    single = entries.where(~grouped).select("image", "node", F.lit(1).cast("long").alias("names"))
    # The key of the walk is made inside the aggregation: many times as long as its path, it is not to be sorted along with each entry.
    first = F.min_by("node", walk_key(F.col("path"))).alias("node")
    linked = entries.where(grouped).groupBy("image", "group_id", "hash").agg(first, F.count("*").alias("names")).select("image", "node", "names")
    held = streams.where("hash is not null").select("image", "node", "hash")
    return single.unionByName(linked).join(held, ["image", "node"]).groupBy("hash").agg(F.sum("names").alias("refs"))


def with_descriptors(entries: DataFrame, descriptors: DataFrame) -> DataFrame:
    """entries(image, sd_id, ...) with the bytes of their security descriptor; an id that its image does not have gives null."""
    return entries.join(descriptors.select("image", "sd_id", F.col("bytes").alias("descriptor")), ["image", "sd_id"], "left")


def walk_key(path: Column) -> Column:
    """Sort key of a depth-first walk whose siblings are in collation order (upper case, then as they are)."""
    return F.transform(F.split(F.trim(path, F.lit("/")), "/"), collation_key)


def preorder(entries: DataFrame) -> DataFrame:
    """Entries with their key of the walk."""
    return entries.withColumn("walk", walk_key(F.col("path")))


def visible(entries: DataFrame) -> DataFrame:
    """Without names that are empty, . or .., or hold a NUL; of siblings with one name the first (by ordinal) stays."""
    named = entries.where(~F.col("name").isin("", ".", "..") & ~F.contains("name", F.lit("\0")))
    first = Window.partitionBy("image", "parent", "name").orderBy("ordinal")
    return named.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def reachable(nodes: DataFrame, rounds: int = 64) -> DataFrame:
    """Nodes (node, parent, name) with their paths; nodes not below a root (null parent) are dropped.

    The paths of all nodes double in reach with each round, so a tree of depth d takes log2(d) joins. A round in which no
    node comes to its root leaves only nodes on or below a circle: those are dropped.
    """
    from vaultframe.operators.settling import settle

    state = settle(nodes.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), "").otherwise(F.concat(F.lit("/"), F.col("name"))).alias("path")))
    left = None
    for _ in range(rounds):
        open_ = state.where("up is not null")
        count = open_.count()
        if count in (0, left):
            break
        left = count
        above = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("path").alias("head"))
        moved = open_.join(above, "up").select("node", F.col("up2").alias("up"), F.concat("head", "path").alias("path"))
        state = settle(moved.unionByName(state.where("up is null")))
    return state.where("up is null").select("node", F.when(F.col("path") == "", "/").otherwise(F.col("path")).alias("path"))


def preferred_stream_kinds(streams: DataFrame) -> DataFrame:
    """streams(inode, slot, stream, hash, attributes) with kind.

    Encrypted inodes have one raw stream, their first unnamed one with content. Otherwise named streams are data; of the
    unnamed ones (slot 0 only with content) the first is the reparse stream of a reparse point, and the next is data.
    """
    encrypted, reparse = F.col("attributes").bitwiseAND(0x4000) != 0, F.col("attributes").bitwiseAND(0x400) != 0
    unnamed = F.coalesce("stream", F.lit("")) == ""
    counts = unnamed & F.when(encrypted, F.col("hash").isNotNull()).otherwise((F.col("slot") > 0) | F.col("hash").isNotNull())
    w = Window.partitionBy("inode").orderBy("slot")
    nth = F.sum(F.when(counts, 1).otherwise(0)).over(w)
    kind = (
        F.when(encrypted, F.when(counts & (nth == 1), "encrypted"))
        .when(~unnamed, "data").when(counts & reparse & (nth == 1), "reparse").when(counts & (nth == F.when(reparse, 2).otherwise(1)), "data")
    )
    total = F.sum(F.when(counts, 1).otherwise(0)).over(Window.partitionBy("inode"))
    fallback = F.when((total == 0) & (F.col("slot") == 0), F.when(encrypted, "encrypted").when(reparse, "reparse").otherwise("data"))
    return streams.withColumn("kind", F.coalesce(kind, fallback, F.lit("unknown")))
