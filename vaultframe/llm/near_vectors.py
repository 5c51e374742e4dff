"""Embedding near-duplicates: all pairs by cosine, compared tile by tile in PCA order.

Unit vectors are rotated to their principal axes. Range-sorted along a curve through the leading coordinates they
are cut into tiles, and tiles in order into strips. A task compares two strips, so that a tile is sent as often as
there are strips (about the square root of the number of tiles), not once for each tile it meets; pairs of strips
whose boxes of leading coordinates are too far apart for the threshold are never formed. In a task, tiles whose
centres are farther apart than their radii and the threshold allow are passed over. Within a pair of tiles, products
accumulate over leading dimensions first; the rest of a product is at most the product of the two suffix norms, so a
comparison stops once the threshold is out of reach. What remains is decided on the vectors as they are, in double
precision.

A task returns a row per linked vector (number of links, a neighbour in its component), never a row per link.
Equal vectors are one row with a multiplicity. The rotation only orders the work: any basis gives the same result.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultframe.llm import arrays as A
from vaultframe.llm.common import components, read, settle, small

THRESHOLD = 0.9
#: Vectors in a tile; leading coordinates in the order and in a box; strips at least, and bytes of vectors in one at most.
TILE, BOX, STRIPS, STRIP_BYTES = 2048, 8, 4, 32 << 20
LAST_ID = (1 << 63) - 1
#: Slack of products in single precision and of bounds; survivors are decided in double precision without any.
SLACK = 1e-5


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """(width, width) orthonormal axes by falling energy; `width` rows of sums reach the driver."""

    def sums(batches):
        total = np.zeros((width, width))
        for batch in batches:
            u = _unit(_matrix(batch.column("v"), width))
            total += u.T @ u
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "s"])

    cells = vectors.select("v").mapInArrow(sums, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    rows = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "s"))).alias("row")).select("i", F.col("row.s").alias("s")).collect()
    moment = np.zeros((width, width))
    for r in rows:
        moment[r["i"]] = r["s"]
    _, axes = np.linalg.eigh(moment)
    return np.ascontiguousarray(axes[:, ::-1])


def _curve(lead: np.ndarray, bits: int = 7) -> np.ndarray:
    """Interleaved bits of coordinates in [-1, 1]."""
    cell = np.clip(((lead + 1) * 0.5 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
    key = np.zeros(len(lead), np.int64)
    for b in range(bits - 1, -1, -1):
        for c in range(lead.shape[1]):
            key = (key << 1) | ((cell[:, c] >> b) & 1)
    return key


def tiles(vectors: DataFrame, axes: np.ndarray, size: int) -> DataFrame:
    """strip, box (lo, hi) and contents (nodes, multiplicities, vectors as given) of each tile."""
    width, box = len(axes), min(BOX, len(axes))
    number = _kind_of(vectors)

    def keyed(batches):
        for batch in batches:
            lead = _unit(_matrix(batch.column("v"), width)) @ axes[:, :box]
            yield pa.record_batch([*batch.columns, pa.array(_curve(lead))], [*batch.schema.names, "at"])

    count = vectors.count()
    ranges = max(1, ceil(count / (2 * size)))
    strips = min(ranges, max(STRIPS, ceil(sqrt(count / size)), ceil(count * width * np.dtype(number).itemsize / STRIP_BYTES)))

    def cut(batches):
        table = pa.Table.from_batches(held, None) if (held := list(batches)) else None
        strip = TaskContext.get().partitionId() * strips // ranges if ranges else 0
        for n in range(0, len(table) if table else 0, size):
            own = table.slice(n, size).combine_chunks()
            x = _matrix(own.column("v").combine_chunks(), width)
            lead = _unit(x) @ axes[:, :box]
            values = {
                "strip": min(strip, strips - 1), "lo": lead.min(axis=0).tolist(), "hi": lead.max(axis=0).tolist(),
                **{c: own.column(c).to_pylist() for c in ("d", "h", "m")}, "x": x.astype(number).tobytes(),
            }
            yield pa.RecordBatch.from_pylist([values], schema=TILES)

    types = vectors.schema["v"].dataType.simpleString()
    sorted_ = vectors.mapInArrow(keyed, f"d bigint, h bigint, m bigint, v {types}, at bigint").repartitionByRange(ranges, "at", "d", "h")
    return sorted_.sortWithinPartitions("at", "d", "h").mapInArrow(
        A.tidy(cut), "strip bigint, lo array<double>, hi array<double>, d array<bigint>, h array<bigint>, m array<bigint>, x binary"
    )


def _kind_of(vectors: DataFrame) -> type:
    """The precision in which vectors are given, and so sent."""
    return np.float32 if isinstance(vectors.schema["v"].dataType.elementType, T.FloatType) else np.float64


_LONGS, _DOUBLES = pa.list_(pa.int64()), pa.list_(pa.float64())
TILES = pa.schema([("strip", pa.int64()), ("lo", _DOUBLES), ("hi", _DOUBLES), ("d", _LONGS), ("h", _LONGS), ("m", _LONGS), ("x", pa.binary())])


def _reach(threshold: float) -> float:
    """Distance of unit vectors whose cosine is the threshold."""
    return sqrt(max(0.0, 2 * (1 - threshold))) + SLACK


def strip_pairs(t: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a <= b: strips whose boxes come as near as vectors of that cosine are; joined by cells of two coordinates."""
    box = len(t.select("lo").first()["lo"])
    ends = [f(F.get(c, F.lit(i))).alias(f"{c}{i}") for f, c in ((F.min, "lo"), (F.max, "hi")) for i in range(box)]
    b = settle(t.groupBy("strip").agg(*ends).select("strip", *[F.array(*[f"{c}{i}" for i in range(box)]).alias(c) for c in ("lo", "hi")]))
    far = _reach(threshold)
    side = max(far, 1e-3)

    def cells(c: int, by: float):
        axis = F.lit(min(c, box - 1))
        return F.sequence(F.floor((F.get("lo", axis) - by) / side), F.floor((F.get("hi", axis) + by) / side))

    wide = b.withColumn("i", F.explode(cells(0, far))).withColumn("j", F.explode(cells(1, far)))
    own = b.withColumn("i", F.explode(cells(0, 0.0))).withColumn("j", F.explode(cells(1, 0.0)))
    own = own.select("i", "j", F.col("strip").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    gap = F.zip_with(
        F.zip_with("lo", "hi2", lambda x, y: x - y), F.zip_with("lo2", "hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))
    )
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    return (
        wide.withColumnRenamed("strip", "a").join(own, ["i", "j"]).where((F.col("a") <= F.col("b")) & (apart <= far * far)).select("a", "b").distinct()
    )


def _blocks(width: int) -> list[int]:
    return sorted({min(width, 8), min(width, 16), min(width, 32), width})


class Tile:
    """Vectors of a tile, rotated, with the norms of what follows each coordinate, a centre and a radius."""

    def __init__(self, x: np.ndarray, axes: np.ndarray, at: int):
        self.unit, self.at = _unit(x.astype(np.float64)), at  # at: place of the first vector in its task
        turned = self.unit @ axes
        self.rest = (np.sqrt(np.maximum(0, 1 - np.cumsum(turned * turned, axis=1))) + SLACK)[:, [k - 1 for k in _blocks(len(axes))]].astype(np.float32)
        self.turned = turned.astype(np.float32)
        self.centre = self.unit.mean(axis=0)
        self.radius = sqrt(((self.unit - self.centre) ** 2).sum(axis=1).max())

    def near(self, other: Tile, reach: float) -> bool:
        return sqrt(((self.centre - other.centre) ** 2).sum()) <= self.radius + other.radius + reach


def linked_in(one: Tile, two: Tile, threshold: float):
    """(i, j) of linked rows, in pieces; of a tile with itself only i < j counts."""
    xr, yr, width = one.turned, two.turned, one.turned.shape[1]
    for n in range(0, len(xr), 512):
        rows, first, total = slice(n, n + 512), 0, np.float32(0)
        for k, last in enumerate(_blocks(width)):
            total = total + xr[rows, first:last] @ yr[:, first:last].T
            first = last
            open_ = total >= threshold - SLACK if last == width else total + np.outer(one.rest[rows, k], two.rest[:, k]) >= threshold - SLACK
            left = np.count_nonzero(open_)
            if not left or left < 0.02 * open_.size:
                break
        if not left:
            continue
        i, j = np.nonzero(open_)
        if one is two:
            i, j = i[i + n < j], j[i + n < j]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)] + n, j[k : k + (1 << 16)]
            hit = np.einsum("ij,ij->i", one.unit[a], two.unit[b]) >= threshold
            if hit.any():
                yield a[hit], b[hit]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Label every node with the least label of its component, given new edges."""
    while True:
        a, b = label[i], label[j]
        if not (apart := a != b).any():
            return
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := label[label], label):
            label[:] = up


def compare(t: DataFrame, pairs: DataFrame, axes: np.ndarray, threshold: float, number: type) -> DataFrame:
    """A row per linked vector of each pair of strips: node (d, h), links there, and a root (d, h) of its component there."""
    width = len(axes)

    def of_pair(table: pa.Table) -> pa.Table:
        d, h, m = (flat(table.column(c)) for c in ("d", "h", "m"))
        strip, a, b = (table.column(c).to_numpy() for c in ("strip", "a", "b"))
        held, at = [], 0
        for raw in table.column("x"):
            x = np.frombuffer(raw.as_buffer(), number).reshape(-1, width)
            held.append(Tile(x, axes, at))
            at += len(x)
        label, links, reach = np.arange(at), np.zeros(at, np.int64), _reach(threshold)
        for p, one in enumerate(held):
            for q in range(p if a[0] == b[0] else 0, len(held)):
                two = held[q]
                if (strip[p], strip[q]) != (a[0], b[0]) or not one.near(two, reach):
                    continue
                for i, j in linked_in(one, two, threshold):
                    i, j = i + one.at, j + two.at
                    np.add.at(links, i, m[j])
                    np.add.at(links, j, m[i])
                    _merge(label, i, j)
        k = np.flatnonzero(links)
        return pa.table({"d": d[k], "h": h[k], "links": links[k], "rd": d[label[k]], "rh": h[label[k]]})

    needed = small(settle(pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("strip"))))
    both = t.select("strip", "d", "h", "m", "x").join(needed, "strip")
    return both.groupBy("a", "b").applyInArrow(of_pair, "d bigint, h bigint, links bigint, rd bigint, rh bigint")


def flat(column: pa.ChunkedArray) -> np.ndarray:
    """Values of a list column, end to end."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])


def similar_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of
    other lengths do not link with each other. Equal rows are vectors of their own and link. A null vec_id comes
    after all others and is never kept beside another member. Other columns are ignored.
    """
    e = F.col("embedding")
    if not isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType):
        e = e.cast("array<double>")
    sound = F.coalesce(
        F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select("vec_id", F.when(sound, e).alias("v"))
    own = F.struct(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST_ID)).alias("d"), F.coalesce(F.xxhash64("v"), F.lit(0)).alias("h"))
    one = settle(rows.where("v is not null").groupBy("v").agg(F.min(own).alias("node"), F.count("*").alias("m")))
    links = None
    for width in sorted(r[0] for r in one.select(F.size("v")).distinct().collect()):
        part = one.where(F.size("v") == width).select("node.d", "node.h", "m", "v")
        axes = principal_axes(part, width)
        t = settle(tiles(part, axes, tile))
        found = compare(t, strip_pairs(t, threshold), axes, threshold, _kind_of(part))
        links = found if links is None else links.unionByName(found)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = settle(links)
    edges = links.select(F.struct("d", "h").alias("u"), F.struct(F.col("rd").alias("d"), F.col("rh").alias("h")).alias("v")).distinct()
    comps = components(edges)
    number = links.groupBy(F.struct("d", "h").alias("node")).agg(F.sum("links").alias("links"))
    by_vector = (
        one.join(number, "node", "left").join(comps.withColumnRenamed("id", "node"), "node", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "node")["d"].alias("root"))
    )
    out = rows.where("v is not null").join(by_vector, "v").select("vec_id", "n_links", F.nullif("root", F.lit(LAST_ID)).alias("component_id"))
    out = out.unionByName(rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector with its links and component."""
    return similar_vectors(read(spark, sf_dir, "embeddings"))


QUERIES = {"op3_embedding_near_dedup": op3_embedding_near_dedup}
