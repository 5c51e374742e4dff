"""Property trees of images: paths of elements, names and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.errors import ArchiveError
from vaultframe.operators import tree


def property_paths(elements: DataFrame) -> DataFrame:
    """elements(id, parent, ordinal, tag, value) with path A/B[2]/C: the n-th child of one tag has [n] from the second on.

    The element without a parent is the root and has an empty path. Siblings of one tag are numbered in one window.
    """
    nth = F.row_number().over(Window.partitionBy("parent", "tag").orderBy("ordinal", "id"))
    step = elements.withColumn("step", F.when(nth == 1, F.col("tag")).otherwise(F.concat("tag", F.lit("["), nth.cast("string"), F.lit("]"))))
    paths = tree.reachable(step.select(F.col("id").alias("node"), "parent", F.col("step").alias("name")))
    return elements.join(paths.select(F.col("node").alias("id"), F.substring("path", 2, 1 << 30).alias("path")), "id")


def children(elements: DataFrame) -> DataFrame:
    """Direct children of each element: parent, position from 1 in document order, tag and value."""
    order = Window.partitionBy("parent").orderBy("ordinal", "id")
    return elements.where("parent is not null").select("parent", F.row_number().over(order).cast("long").alias("position"), "tag", "value")


def with_name(images: DataFrame, image_id: int, name: str) -> DataFrame:
    """images(image_id, image, ...) with one renamed. A name that another image has is refused, an empty one is not."""
    if images.where(F.col("image_id") == image_id).isEmpty():
        raise ArchiveError("invalid_image", str(image_id))
    if name and not images.where((F.col("image_id") != image_id) & (F.col("image") == name)).isEmpty():
        raise ArchiveError("image_name_collision", name)
    return images.withColumn("image", F.when(F.col("image_id") == image_id, name).otherwise(F.col("image")))
