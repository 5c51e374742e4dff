"""Physical layout: split parts, solid offsets and order, chunks and spans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.errors import ArchiveError
from vaultframe.functions import base_name, extension
from vaultframe.operators.settling import settle


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows range-partitioned and sorted by order, with their partition's number, settled."""
    return settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id()))


def _block_offsets(rows: DataFrame, size: str) -> DataFrame:
    """block and the sum of sizes in the blocks before it: one row per partition."""
    w = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("block").agg(F.sum(size).alias("s")).select("block", F.coalesce(F.sum("s").over(w), F.lit(0)).cast("long").alias("before"))


def running_offsets(rows: DataFrame, order: list[str], size: str = "size") -> DataFrame:
    """rows with offset: the sizes of all rows before it in the order. Only a sum per partition meets in one place."""
    placed = _ranged(rows, order)
    own = Window.partitionBy("block").orderBy(*order)
    return placed.join(F.broadcast(_block_offsets(placed, size)), "block").withColumn("offset", (F.sum(size).over(own) - F.col(size) + F.col("before")).cast("long")).drop("block", "before")


def solid_order(entries: DataFrame) -> DataFrame:
    """hash, name and sort key of each content for compression: unnamed first, names without extension next, then by folded extension, folded name and first path.

    A content's name is the shortest of its files' names (of equal lengths the least path's).
    """
    name = F.min(F.struct(F.length("name").alias("n"), "path", "name"))
    per = entries.groupBy("hash").agg(name.alias("f"), F.min("path").alias("first_path")).select("hash", "f.name", "first_path")
    ext = extension(base_name(F.col("name")))
    return per.withColumn("key", F.struct((F.coalesce("name", F.lit("")) != "").alias("a"), ext.isNotNull().alias("b"), F.coalesce(F.upper(ext), F.lit("")).alias("c"), F.upper("name").alias("d"), F.col("first_path").alias("e")))


def split_parts(blobs: DataFrame, order: list[str], target: int, seed: int = 0, solid: bool = False) -> DataFrame:
    """blobs(size, ...) with part: filled in order, a new part beginning where a part with bytes would reach the target.

    seed bytes (metadata) lie in part 1. A blob larger than the target has a part of its own.

    The rule is sequential, yet no task sees all rows: each range partition works out, for every place where the first
    new part may begin in it, what it passes on (bytes in its open part, parts begun); the driver then follows one
    such row per partition.
    """
    if target <= 0:
        raise ArchiveError("invalid_param", "target")
    if solid:
        raise ArchiveError("unsupported", "solid resources cannot be split")
    rows = _ranged(blobs, order)

    def following(sums: np.ndarray) -> np.ndarray:
        """For a part that begins at each row: where the next one begins."""
        start = sums[:-1]
        return np.maximum(np.searchsorted(sums[1:], start + target), np.searchsorted(sums, start, "right"))

    def passed_on(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.concatenate([[0], np.cumsum(pdf.sort_values(order, kind="stable")["size"].to_numpy(np.int64))])
        n = len(sums) - 1
        jump, count = np.append(np.minimum(following(sums), n), n), np.append(np.ones(n, np.int64), 0)
        last = np.append(np.where(jump[:n] == n, np.arange(n), -1), -1)
        for _ in range(max(1, n.bit_length())):  # pointer jumping to the last part that begins here
            inner = jump < n
            last, count = np.where((last < 0) & inner, last[jump], last), count + np.where(inner, count[jump], 0)
            jump = np.where(inner, jump[jump], jump)
        at = np.arange(n + 1)
        begin = np.where(at < n, np.where(last >= 0, last, at), 0)
        room = at[(sums[:-1].searchsorted(min(target, sums[-1]) + 1) >= at) | (at == n)]  # the first part ends within one target
        return pd.DataFrame({"block": pdf["block"].iloc[0], "at": room, "reach": np.append(sums[1:], -1)[room], "sum": sums[room], "left": np.where(room < n, sums[n] - sums[begin[room]], sums[n]), "begun": np.where(room < n, count[room], 0)})

    tables = settle(rows.select("block", *order, "size").groupBy("block").applyInPandas(passed_on, "block int, at long, reach long, sum long, left long, begun long"))
    open_, part, entry = seed, 1, []
    for (block,) in sorted(tables.select("block").distinct().collect()):
        entry.append((block, open_, part))
        first = (F.col("reach") >= F.lit(target - open_)) & (F.col("sum") + F.lit(open_) != 0) & (F.col("reach") >= 0)
        hit = tables.where((F.col("block") == block) & first).orderBy("at").first()
        if hit is None:
            open_ += tables.where((F.col("block") == block) & (F.col("reach") < 0)).first()["left"]
        else:
            open_, part = hit["left"], part + hit["begun"]
    at_entry = dict((b, (o, p)) for b, o, p in entry)
    schema = rows.schema

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        sums = np.concatenate([[0], np.cumsum(pdf["size"].to_numpy(np.int64))])
        held, number = at_entry[int(pdf["block"].iloc[0])]
        n = len(pdf)
        begin = max(int(np.searchsorted(sums[1:], target - held)), int(np.searchsorted(sums, -held, "right")))
        after, out = following(sums), np.full(n, number, np.int64)
        while begin < n:
            number += 1
            out[begin:] = number
            begin = int(after[begin])
        return pdf.assign(part=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return rows.groupBy("block").applyInPandas(numbered, f"{fields}, part long").drop("block")


def chunks_for(resources: DataFrame, start: Column, end: Column) -> DataFrame:
    """resources(resource, size, chunk_size) with the chunks that a byte range needs: first, last and their bytes."""
    first, last = F.floor(start / F.col("chunk_size")), F.floor((end - 1) / F.col("chunk_size"))
    return resources.where((start < end) & (end <= F.col("size"))).select(
        "resource", first.cast("long").alias("first_chunk"), last.cast("long").alias("last_chunk"),
        (F.least((last + 1) * F.col("chunk_size"), F.col("size")) - first * F.col("chunk_size")).cast("long").alias("decoded"),
    )


def assigned_resources(blobs: DataFrame, spans: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Interval join: blobs(hash, offset) with the resource whose span [low, high) holds the offset, by cells of `width`."""
    cells = spans.where("low < high").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    keyed = blobs.withColumn("cell", F.floor(F.col("offset") / width))
    return keyed.join(cells, "cell").where((F.col("offset") >= F.col("low")) & (F.col("offset") < F.col("high"))).select("hash", "resource", (F.col("offset") - F.col("low")).alias("inner"))


def overlaps(spans: DataFrame) -> DataFrame:
    """Spans (owner, low, high) that begin before one before them ends, per owner."""
    w = Window.partitionBy("owner").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reach", F.max("high").over(w)).where("low < reach").select("owner", "low", "high", "reach")


def targets_by_content(entries: DataFrame) -> DataFrame:
    """What an extraction writes: of each content its canonical names (one per inode), so that it is read once; the other names are links."""
    first = entries.where("hash is not null").groupBy("image", "inode", "hash", "size").agg(F.min("path").alias("path"), F.count("*").alias("names"))
    return first.groupBy("hash", "size").agg(F.count("*").alias("targets"), F.sum(F.col("names") - 1).alias("links"), F.min("path").alias("first_path"))
