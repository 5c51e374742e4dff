"""Images: statistics, selection, union, deletion, overlay, comparison, parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.errors import ArchiveError
from vaultframe.functions import DIRECTORY, equal_within, has_bits


def folders(entries: DataFrame) -> DataFrame:
    """image and path of every directory that entries' paths imply, the root among them."""
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda i: F.concat_ws("/", F.slice(steps, 1, i)))
    up = entries.select("image", F.explode(above).alias("p")).distinct()
    return up.select("image", F.when(F.col("p") == "", "/").otherwise(F.col("p")).alias("path"))


def image_stats(entries: DataFrame) -> DataFrame:
    """Per image: directories (implied, root included), files, bytes of all names, and bytes of names after an inode's first."""
    files = entries.where(~has_bits(F.col("attributes"), DIRECTORY))
    by_inode = files.groupBy("image", "inode").agg(F.count("*").alias("names"), F.sum("size").alias("total"), F.min(F.struct("path", "size")).alias("first"))
    per = by_inode.groupBy("image").agg(
        F.sum("names").alias("file_count"), F.sum("total").alias("total_bytes"), F.sum(F.col("total") - F.col("first.size")).alias("hardlink_bytes")
    )
    return folders(entries).groupBy("image").agg(F.count("*").alias("dir_count")).join(per, "image", "left").fillna(0)


def selected(entries: DataFrame, order: list[str], known: set[str] | None = None) -> DataFrame:
    """Entries of the named images, numbered in that order. A name twice is refused, and so is an unknown one if known is given."""
    if len(set(order)) != len(order):
        raise ArchiveError("invalid_param", "an image is named twice")
    if known is not None and (lost := [x for x in order if x not in known]):
        raise ArchiveError("invalid_image", str(lost))
    number = F.create_map(*[F.lit(x) for pair in ((n, i + 1) for i, n in enumerate(order)) for x in pair]) if order else F.lit(None)
    if not order:
        return entries.limit(0).withColumn("image_id", F.lit(0))
    return entries.where(F.col("image").isin(order)).withColumn("image_id", F.element_at(number, F.col("image")))


def without_image(images: DataFrame, name: str) -> DataFrame:
    """The image list (image_id, image) without one; those after it move up."""
    gone = images.where(F.col("image") == name).agg(F.min("image_id").alias("gone"))
    return images.where(F.col("image") != name).crossJoin(F.broadcast(gone)).select(
        (F.col("image_id") - F.when(F.col("image_id") > F.col("gone"), 1).otherwise(0)).alias("image_id"), "image"
    )


def exported(target: DataFrame, source: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Entries of target and of source's images (all, or those named). An image name on both sides is refused."""
    taken = source if names is None else source.where(F.col("image").isin(names))
    if (clash := taken.select("image").distinct().join(target.select("image").distinct(), "image").first()) is not None:
        raise ArchiveError("image_name_collision", clash["image"])
    return target.unionByName(taken)


def joined_parts(parts: list[dict], entries: list[DataFrame]) -> DataFrame:
    """Blob rows of a split set in part order, each hash from the lowest part that has it.

    parts: guid, part_number, total_parts for each of entries. Incomplete, double or foreign parts are refused.
    """
    if not parts:
        raise ArchiveError("invalid_param", "no parts")
    numbers = sorted(p["part_number"] for p in parts)
    if len({(p["guid"], p["total_parts"]) for p in parts}) != 1 or numbers != list(range(1, parts[0]["total_parts"] + 1)):
        raise ArchiveError("split_invalid")
    every = reduce(DataFrame.unionByName, [e.withColumn("part", F.lit(p["part_number"])) for p, e in zip(parts, entries, strict=True)])
    return joined(every)


def joined(every: DataFrame) -> DataFrame:
    rest = [c for c in every.columns if c not in ("hash", "part")]
    return every.groupBy("hash").agg(F.min(F.struct("part", *rest)).alias("f")).select("hash", "f.*")


def overlay(layers: DataFrame, replace: bool = True) -> tuple[DataFrame, DataFrame]:
    """(entries, clashes) of layers(layer, path, is_dir, ...): of each path the last layer's entry.

    A directory merges with a directory and a file replaces a file (unless replace is False); a directory and a file
    of one path clash, and so do two files then.
    """
    rest = [c for c in layers.columns if c not in ("path", "layer")]
    by_path = layers.groupBy("path").agg(
        F.max(F.struct("layer", *rest)).alias("top"), F.min("is_dir").alias("some_file"), F.max("is_dir").alias("some_dir"), F.sum(F.when(~F.col("is_dir"), 1).otherwise(0)).alias("files")
    )
    clash = (F.col("some_file") != F.col("some_dir")) | (F.lit(not replace) & (F.col("files") > 1))
    return by_path.where(~clash).select("path", "top.*"), by_path.where(clash).select("path", F.when(F.col("some_file") != F.col("some_dir"), "directory and file").otherwise("not replaced").alias("clash"))


def difference(a: DataFrame, b: DataFrame, on: list[str], compared: list[str], within: dict[str, int] | None = None, ignored_bits: int = 0) -> DataFrame:
    """Rows that differ between two trees: only in one, or with other values in the compared columns.

    within allows columns (times) to differ by so much; ignored_bits are bits of `attributes` that do not count.
    """
    within = within or {}
    left = a.select(*on, F.struct(*compared).alias("x"))
    right = b.select(*on, F.struct(*compared).alias("y"))
    both = left.join(right, on, "full")

    def same(c: str) -> Column:
        x, y = F.col("x")[c], F.col("y")[c]
        if c in within:
            return equal_within(x, y, within[c])
        if c == "attributes" and ignored_bits:
            return x.bitwiseAND(~ignored_bits).eqNullSafe(y.bitwiseAND(~ignored_bits))
        return x.eqNullSafe(y)

    alike = reduce(Column.__and__, [same(c) for c in compared])
    kind: Column = F.when(F.col("y").isNull(), "only_first").when(F.col("x").isNull(), "only_second").when(~alike, "changed")
    return both.select(*on, kind.alias("kind")).where("kind is not null")


def exported_images(target: DataFrame, source: DataFrame, no_names: bool = False, no_descriptions: bool = False, gift: bool = False) -> tuple[DataFrame, DataFrame]:
    """(target, source) after all images (image, description, digest) of source were added to target, in lists of images.

    Names and descriptions may be left behind; as a gift the source has none left. An image that target has (by the
    digest of its metadata) is refused, and so is a name on both sides.
    """
    if (twin := source.join(target.select("digest"), "digest").first()) is not None:
        raise ArchiveError("duplicate_exported_image", twin["digest"])
    moved = source.withColumn("image", F.lit("")) if no_names else source
    moved = moved.withColumn("description", F.lit("")) if no_descriptions else moved
    if (clash := moved.where("image <> ''").join(target.select("image"), "image").first()) is not None:
        raise ArchiveError("image_name_collision", clash["image"])
    return target.unionByName(moved), source.where(F.lit(False)) if gift else source


def remapped_descriptors(descriptors: DataFrame) -> DataFrame:
    """image, sd_id and new_id: equal descriptors (bytes) of all images share one number, by the order of their bytes."""
    return descriptors.join(
        _numbered(descriptors.select("bytes").distinct(), "bytes", "new_id"), "bytes"
    ).select("image", "sd_id", "new_id")


def _numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Rows numbered from 0 in order, by counts of range partitions rather than in one task."""
    from pyspark.sql import Window

    from vaultframe.operators.settling import settle

    # Settled, so that both uses see the same ranges.
    parts = settle(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    own = Window.partitionBy("__p").orderBy(order)
    return parts.join(F.broadcast(before), "__p").withColumn(name, (F.row_number().over(own) - 1 + F.col("__before")).cast("long")).drop("__p", "__before")
