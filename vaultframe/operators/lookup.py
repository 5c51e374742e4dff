"""Lookup tables: from raw records to the contents and metadata that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.functions import has_bits
from vaultframe.operators import layout

#: Fixed flag bits of a record, and the size that marks a record of a solid resource.
METADATA, COMPRESSED, SOLID = 0x2, 0x4, 0x10
MARKER = 1 << 32


def faults(rows: DataFrame) -> DataFrame:
    """Records that are refused: neither compressed nor solid, but stored in another size than their own."""
    plain = ~has_bits(F.col("flags"), COMPRESSED) & ~has_bits(F.col("flags"), SOLID)
    return rows.where(plain & (F.col("stored") != F.col("size")))


def data_rows(rows: DataFrame, part: int = 1) -> DataFrame:
    """Contents of a part: records without hash or bytes, of other parts and of metadata drop out; of equal hashes the first row stays."""
    held = rows.where(F.col("hash").isNotNull() & (F.col("size") > 0) & (F.col("part") == part) & ~has_bits(F.col("flags"), METADATA) & (F.col("size") != MARKER))
    rest = [c for c in held.columns if c not in ("hash", "row")]
    return held.groupBy("hash").agg(F.min(F.struct("row", *rest)).alias("f")).select("hash", "f.*")


def metadata_rows(rows: DataFrame, image_count: int, part: int = 1) -> DataFrame:
    """Metadata records of the first part as images 1, 2, ... in row order, no more than the header counts; other parts have none."""
    own = rows.where(has_bits(F.col("flags"), METADATA) & F.lit(part == 1)).orderBy("row").limit(image_count)
    return own.withColumn("image_id", F.row_number().over(Window.orderBy("row")).cast("long"))


def solid_rows(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Contents of solid groups: row, hash, size, the row of their resource, and the offset in it.

    A run of solid records without a gap is a group; those of the marker's size are its resources, which follow each
    other in one space of bytes with the sizes that sizes(row, resource_size) read from them. Rows are numbered
    without gaps. Runs and bytes are counted over range partitions, not in one task.
    """
    solid = rows.where(has_bits(F.col("flags"), SOLID))
    before = solid.select((F.col("row") + 1).alias("row"), F.lit(0).alias("start"))
    marked = solid.join(before, "row", "left").withColumn("start", F.coalesce("start", F.lit(1)))
    marked = marked.join(sizes, "row", "left").withColumn("space", F.when(F.col("size") == MARKER, F.col("resource_size")).otherwise(0))
    run = (F.col("offset") + F.col("start")).alias("run")
    placed = layout.running_offsets(marked.withColumnRenamed("offset", "at"), ["row"], "start").select("row", "hash", "size", "at", "space", run)
    placed = layout.running_offsets(placed, ["row"], "space").withColumnRenamed("offset", "low")
    resources = placed.where(F.col("size") == MARKER)
    base = placed.groupBy("run").agg(F.min("low").alias("base"))
    spans = resources.select(F.col("row").alias("resource"), "low", (F.col("low") + F.col("space")).alias("high"))
    wanted = placed.where(F.col("size") != MARKER).join(base, "run").select(F.col("row").alias("hash"), (F.col("base") + F.col("at")).alias("offset"))
    found = layout.assigned_resources(wanted, spans).select(F.col("hash").alias("row"), "resource", "inner")
    return placed.select("row", "hash", "size").join(found, "row")
