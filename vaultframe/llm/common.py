"""Helpers shared by the training-data operators: lineage cuts, checked broadcasts, row identity, components."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of a small table that may be broadcast; beyond either, operators use a shuffled join instead.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with checkpoint() in the folder that the cluster names in spark.checkpoint.dir.

    Only on one machine (a local master, as in tests) is a folder of our own set where the session names none. Shuffle
    files that only served what was cut are given up at once: Spark's cleaner removes those that garbage collection
    finds unused, and with spark.cleaner.referenceTracking.cleanCheckpoints the checkpoints that nothing reads any more.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    out = df.checkpoint()
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def _width(name: str, kind: T.DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(name)), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType)):
            return F.aggregate(F.coalesce(F.col(name), F.array()), F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16) + 16
        return F.greatest(F.size(name), F.lit(0)) * 16 + 16
    return F.lit(32 if isinstance(kind, T.StructType) else 16)


def small(df: DataFrame, most: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the (settled) table has at most `most` rows and about `size` bytes, else the table as it is."""
    width = sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(0)).cast("long")
    rows, held = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= most and held <= size else df


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds __h, a hash of the text; (doc_id, __h) names a document even if ids repeat or are null."""
    return df.withColumn("__h", F.xxhash64(text_of(text)))


def numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with columns c0, c1, ..., so that no name clashes with ours, and the names of doc_id and text there."""
    names = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), f"c{names.index('doc_id')}", f"c{names.index('text')}"


def named(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, under their names, of a frame made from numbered(docs)."""
    return df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v): one row (id, component) per node, component being its smallest id.

    Alternating large-star and small-star steps, each round one job with one checkpoint, until all edges lead straight
    to a centre. The least neighbour of each node is a map-side minimum and is dealt anew before the edges meet it, so
    that both sides of the join are plain shuffles and Spark can split the edges of a node with very many neighbours
    between tasks.
    """
    e = settle(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    done = _stars(e)
    for _ in range(rounds):
        if done:
            break
        e = settle(_small_star(_large_star(e)))
        done = _stars(e)
    if not done:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def extended(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (id, component) after further edges (u, v): only what the edges join is worked out anew.

    Edges are carried over to the least ids of the components at their ends, so what was joined before is not followed
    again; nodes that no component holds stand for themselves. comps is settled.
    """
    end = lambda n: comps.select(F.col("id").alias(n), F.col("component").alias(f"c{n}"))
    moved = edges.join(end("u"), "u", "left").join(end("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    more = settle(components(moved))
    now = small(more.select(F.col("id").alias("component"), F.col("component").alias("now")))
    old = comps.join(now, "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    return old.unionByName(more.join(comps.select("id"), "id", "left_anti"))


def _stars(e: DataFrame) -> bool:
    """Whether each edge (u, v) is the only one of its u and no v is a u: then v is the component of u."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.where("up > 1 or (up > 0 and down > 0)").agg(F.count("*")).first()[0]


def _least(e: DataFrame) -> DataFrame:
    """(u, m): the least v of each u, dealt evenly."""
    return e.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = _least(e)
    moved = e.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
