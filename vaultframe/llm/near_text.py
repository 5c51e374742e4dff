"""MinHash near-duplicates of texts: DartMinHash signatures, banded joining, exact check, components.

A text is a weighted set of word shingles. Hashed darts fall on a plane (weight, rank) above each shingle, the
same for a shingle wherever it occurs; a dart counts if it falls below the shingle's weight and below the text's
rank limit, which lets about k ln k + 2 k darts through whatever the number of shingles. Darts are dealt to k
coordinates, and the one of least rank is kept in each: coordinates of two texts agree with the probability of
their weighted Jaccard similarity, and a signature costs time in the number of shingles plus darts.

Bands of coordinates are bucket keys. Equal texts are one row before any of this. In a bucket, members are
compared with a leader; what leaders did not connect is compared across the components found so far, as far as a
prefix filter leaves pairs. So a bucket of many near copies costs about as many pairs as it has members, and still
no link is lost.
"""

from __future__ import annotations

from math import ceil, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm import arrays as A
from vaultframe.llm.common import components, extended, named, numbered, read, row_key, settle, small

WORDS, THRESHOLD = 5, 0.8
#: Bands and coordinates in a band: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**5)**26 > 0.9999.
BANDS, WIDTH = 26, 5
LAST_ID = (1 << 63) - 1


def _poisson(mean: float) -> np.ndarray:
    """Cumulative distribution, as thresholds of a uniform number."""
    most = ceil(mean + 12 * mean**0.5 + 16)
    return np.minimum(np.cumsum([np.exp(i * log(mean) - mean - lgamma(i + 1)) for i in range(most)]), 1.0)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_signatures(elements: np.ndarray, weights: np.ndarray, row: np.ndarray, rows: int, k: int) -> np.ndarray:
    """(rows, k) signatures of weighted sets given as elements (hashes) with weights and sorted rows.

    Weights are cut at 1, 3, 7 ...; ranks at 1/64, 1/32, 1/16 ... In each cell the number of darts is Poisson with
    its area as mean, and number and places depend on the element and the cell alone.
    """
    total = np.bincount(row, weights, rows)
    limit = (k * log(k) + 2 * k) / np.maximum(total, 1e-12)
    reach = limit[row]
    slots, ranks, names = [], [], []
    level = 0
    while len(elements) and (above := weights > 2.0**level - 1).any():
        low, width = 2.0**level - 1, 2.0**level
        e, w, r, top = elements[above], weights[above], row[above], reach[above]
        strip, a, b = 0, 0.0, 2.0**-6
        while True:
            into = top > a
            if not into.any():
                break
            e, w, r, top = e[into], w[into], r[into], top[into]
            seed = A.mix(e + np.uint64((level * 64 + strip + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            count = np.searchsorted(_poisson((b - a) * width), _uniform(seed), "right")
            which = np.repeat(np.arange(len(e)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            dart = A.mix(seed[which] + (nth + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            place = A.mix(dart ^ np.uint64(0xA0761D6478BD642F))
            rank = a + (b - a) * _uniform(dart)
            hit = (rank < top[which]) & (low + width * _uniform(place) < w[which])
            which, dart, rank = which[hit], dart[hit], rank[hit]
            slots.append(r[which] * k + (A.mix(dart ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(k)).astype(np.int64))
            ranks.append(rank)
            names.append(dart)
            strip, a, b = strip + 1, b, 2 * b
        level += 1
    best, out = np.full(rows * k, np.inf), np.zeros(rows * k, np.uint64)
    if slots:
        slot, rank, name = np.concatenate(slots), np.concatenate(ranks), np.concatenate(names)
        np.minimum.at(best, slot, rank)
        won = rank == best[slot]
        out[slot[won]] = name[won]
    return out.reshape(rows, k)


def _band_keys(signatures: np.ndarray, bands: int, width: int) -> np.ndarray:
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(signatures), bands)).copy()
    for k in range(width):
        total = A.mix(total + signatures.reshape(len(signatures), bands, width)[:, :, k])
    return A.signed(total)


def signatures(docs: DataFrame, size: int, bands: int, width: int) -> DataFrame:
    """doc_id, __h, c1, c2 (what the words are, as 128 bits), n (shingles, repeats counted) and bands (bucket keys) of each row."""

    def per_batch(batches):
        for batch in batches:
            data, offsets = A.column_bytes(batch.column("text"))
            for a, b in A.slices(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                start, end, row = A.word_spans(part, at)
                word, rows = A.Rolling(part).of(start, end), b - a
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                whole = [np.zeros(rows, np.uint64) for _ in range(2)]
                for n, out in enumerate(whole):
                    np.add.at(out, row, A.mix(word + A.mix(nth.astype(np.uint64) + np.uint64(n << 40))))
                h, r, count = A.distinct(*A.shingles(word, row, rows, size))
                keys = _band_keys(dart_signatures(h, count.astype(float), r, rows, bands * width), bands, width)
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(a, rows), batch.column("__h").slice(a, rows),
                        *[pa.array(A.signed(x)) for x in whole], pa.array(np.bincount(r, count, rows).astype(np.int64)),
                        pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64())),
                    ],
                    ["doc_id", "__h", "c1", "c2", "n", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return row_key(docs.select("doc_id", "text")).mapInArrow(
        A.tidy(per_batch), f"doc_id {kind}, __h bigint, c1 bigint, c2 bigint, n bigint, bands array<bigint>"
    )


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """node and its weighted shingles, of rows that have a node: a shingle of weight w is itself and w - 1 further elements."""

    def per_batch(batches):
        for batch in batches:
            data, offsets = A.column_bytes(batch.column("text"))
            for a, b in A.slices(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                start, end, row = A.word_spans(part, at)
                h, r, count = A.distinct(*A.shingles(A.Rolling(part).of(start, end), row, b - a, size))
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                h, r = np.repeat(h, count), np.repeat(r, count)
                h = np.where(nth > 0, A.mix(h + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), h)
                yield pa.record_batch([batch.column("d").slice(a, b - a), batch.column("__h").slice(a, b - a), A.listed(A.signed(h), r, b - a)], ["d", "h", "own"])

    found = docs.select("d", "__h", "text").mapInArrow(A.tidy(per_batch), "d bigint, h bigint, own array<bigint>")
    return found.select(F.struct("d", "h").alias("node"), "own")


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose weighted shingles have at least that Jaccard similarity."""
    a = sets.select(F.col("node").alias("u"), F.col("own").alias("x"))
    b = sets.select(F.col("node").alias("v"), F.col("own").alias("y"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("both"))
    return both.where(F.col("both") >= F.lit(threshold - 1e-9) * (F.col("m") + F.col("n") - F.col("both"))).select("u", "v")


def near_duplicates(
    docs: DataFrame, size: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, width: int = WIDTH, leaders: int = 2
) -> DataFrame:
    """One row per row of docs: doc_id, __h (hash of the text), class_id (least doc_id of its class) and kept.

    Texts whose words are equal are one class; classes also join where the weighted Jaccard similarity of their
    shingles reaches the threshold: a shingle weighs as often as it occurs, in the signatures and in the exact check.
    Texts without words (null, empty) are alone. A null doc_id comes after all others. Of rows with one doc_id and
    other texts each is a document; of equal rows each gets the same result. Other columns are ignored.
    """
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    rows = settle(signatures(docs, size, bands, width))
    one = (
        rows.where("n > 0").groupBy("c1", "c2")
        .agg(F.min(F.struct(d.alias("d"), F.col("__h").alias("h"))).alias("node"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    )
    one = settle(one)
    member = one.select("node", "n", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("in"), F.min("node").alias("least")).where("in > 1").drop("in")
    member = settle(member.join(shared, "key"))
    wanted = settle(member.select("node").distinct())
    keyed = row_key(docs.select("doc_id", "text")).select(d.alias("d"), "__h", "text")
    w = small(wanted.select(F.col("node.d").alias("wd"), F.col("node.h").alias("wh")))
    texts = keyed.join(w, (F.col("d") == F.col("wd")) & (F.col("__h") == F.col("wh")), "left_semi")
    sets = settle(shingle_sets(texts, size).groupBy("node").agg(F.first("own").alias("own")))

    comps = _linked(member, sets, threshold, leaders)
    linked = one.select("c1", "c2", "node")
    if comps is not None:
        linked = linked.join(comps.select(F.col("id").alias("node"), "component"), "node", "left").select("c1", "c2", F.coalesce("component", "node").alias("root"))
    else:
        linked = linked.withColumnRenamed("node", "root").select("c1", "c2", "root")
    own = F.struct(d.alias("d"), F.col("__h").alias("h"))
    out = rows.select("doc_id", "__h", "c1", "c2", "n").join(linked, ["c1", "c2"], "left")
    root = F.when(F.col("n") > 0, F.col("root")).otherwise(own)
    return out.select("doc_id", "__h", F.nullif(root["d"], F.lit(LAST_ID)).alias("class_id"), (root == own).alias("kept"))


def _linked(member: DataFrame, sets: DataFrame, threshold: float, leaders: int) -> DataFrame | None:
    """Components (id, component) of similar members of buckets (key, node, n, least); None without links.

    Members are compared with one leader of their bucket at a time: the least, then in turn the one with most links so
    far and one by chance. Only buckets whose members are still in several components take part again. Then the
    pairs across components that a prefix filter leaves are compared.
    """
    found = settle(_similar(settle(member.select(F.col("node").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()), sets, threshold))
    if found.isEmpty():
        comps = None
    else:
        comps = settle(components(found))
    left, idle = member, 0
    for turn in range(1, leaders + 1):
        left = settle(_mixed(left, comps))
        sizes = left.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
        members, across = sizes.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.lit(0))).first()
        if not members or across <= members + 10_000 or idle:
            break
        ranked = left.withColumn("rank", F.xxhash64("node", F.lit(turn)))
        if turn % 2 and not found.isEmpty():
            degree = found.select(F.col("u").alias("node")).unionByName(found.select(F.col("v").alias("node"))).groupBy("node").agg((-F.count("*")).alias("d"))
            ranked = left.join(degree, "node", "left").withColumn("rank", F.coalesce("d", F.lit(0)))
        lead = ranked.groupBy("key").agg(F.min_by(F.struct("node", "c"), F.struct("rank", "node")).alias("lead"))
        pairs = left.join(lead, "key").where(F.col("c") != F.col("lead.c")).select(F.greatest("node", F.col("lead.node")).alias("u"), F.least("node", F.col("lead.node")).alias("v"))
        new = settle(_similar(settle(pairs.distinct()), sets, threshold))
        idle = idle + 1 if new.isEmpty() else 0
        if not idle:
            found = found.unionByName(new)
            comps = settle(_joined(comps, new))
    left = settle(_mixed(left, comps))
    pairs = _prefix_pairs(left, sets, threshold)
    new = settle(_similar(settle(pairs), sets, threshold))
    return comps if new.isEmpty() else settle(_joined(comps, new))


def _joined(comps: DataFrame | None, edges: DataFrame) -> DataFrame:
    return components(edges) if comps is None else extended(comps, edges)


def _prefix_pairs(left: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) across components that can be similar: all of them that share a bucket, and few others.

    Sets of sizes m and n that reach the threshold share at least a = threshold / (1 + threshold) * (m + n) shingles, so
    they share one of the n - a + 1 rarest of each. With m the least size that a member's buckets offer, a heavily
    edited copy has only its own shingles in that prefix, and meets nothing. A pair counts where what is left of both from
    the shared shingle on can still hold a: at the first shingle that two similar sets share it always does.
    """
    part = threshold / (1 + threshold)
    sizes = left.groupBy("key").agg(F.collect_set("n").alias("sizes"))
    least = F.array_min(F.filter("sizes", lambda m: m >= F.lit(threshold - 1e-9) * F.col("n")))
    nodes = left.join(sizes, "key").groupBy("node", "n", "c").agg(F.min(least).alias("m"))
    held = settle(sets.join(nodes, "node").select("node", "n", "c", "m", "own"))
    each = held.select("node", F.explode("own").alias("s"))
    several = each.groupBy("s").agg(F.count("*").alias("k")).where("k > 1")
    rare = each.join(several, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("rare")).join(held.drop("own"), "node")
    alone = F.col("n") - F.size("rare")
    length = F.col("n") - F.ceil(F.lit(part) * (F.col("n") + F.col("m")) - 1e-9) + 1 - alone
    post = rare.where(length > 0).select("node", "n", "c", alone.alias("alone"), F.posexplode(F.slice("rare", 1, length.cast("int"))).alias("i", "r"))
    post = settle(post.select("node", "n", "c", (F.col("n") - F.col("alone") - F.col("i")).alias("rest"), "r.s"))
    other = post.select("s", F.col("node").alias("v"), F.col("c").alias("cv"), F.col("n").alias("nv"), F.col("rest").alias("restv"))
    fit = F.least("rest", "restv") >= F.lit(part) * (F.col("n") + F.col("nv")) - 1e-9
    return post.join(other, "s").where((F.col("node") > F.col("v")) & (F.col("c") != F.col("cv")) & fit).select(F.col("node").alias("u"), "v").distinct()


def _mixed(member: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Members with their component c, of the buckets that hold several components."""
    member = member.select("key", "node", "n")
    if comps is None:
        return member.withColumn("c", F.col("node"))
    now = member.join(comps.select(F.col("id").alias("node"), "component"), "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c"))
    several = now.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    return now.join(several, "key", "left_semi")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each class; equal rows (doc_id and text) become one; columns stay."""
    found = settle(near_duplicates(docs))
    gone = settle(found.where("not kept").select(F.col("doc_id").alias("__id"), F.col("__h").alias("__k")).distinct())
    twice = settle(found.where("kept").groupBy("doc_id", "__h").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("__h").alias("__k")))
    plain, doc_id, text = numbered(docs)
    keyed = row_key(plain, text)
    same = lambda t: keyed[doc_id].eqNullSafe(t["__id"]) & (keyed["__h"] == t["__k"])
    keyed = keyed.join(small(gone), same(gone), "left_anti")
    once = keyed.join(small(twice), same(twice), "left_anti")
    many = keyed.join(small(twice), same(twice), "left_semi").dropDuplicates([doc_id, "__h"])
    return named(once.unionByName(many), docs)


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the class of its near copies."""
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


QUERIES = {"op2_minhash_near_dedup": op2_minhash_near_dedup}
