"""Selectors: images, paths, globs, exclusions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.errors import ArchiveError
from vaultframe.functions import exclusion_pattern, glob_pattern

#: Roots of a selection that may be broadcast; levels of the tree beyond them are joined by a shuffle.
BROAD = 10_000


def resolved_images(selectors: DataFrame, images: DataFrame) -> DataFrame:
    """selector and image_id: 0 is none, -1 all. selectors(selector), images(image_id, image) from 1.

    A whole number within range wins (a sign + and leading space may precede it), one beyond it is none, and 0 is
    looked up as a name like any other text. Names match exactly; of equal names the lowest number counts.
    """
    total = images.agg(F.count("*").alias("total"))
    names = images.groupBy(F.col("image").alias("selector")).agg(F.min("image_id").alias("by_name"))
    s = F.col("selector")
    digits = F.regexp_extract(s, r"^[ \t\n\r\f]*\+?([0-9]+)$", 1)
    number = digits.try_cast("long")
    result = (
        F.when(s.isNull() | (s == ""), 0).when((F.lower(s) == "all") | (s == "*"), -1)
        .when((digits != "") & number.isNull(), 0).when((digits != "") & (number > 0), F.when(number <= F.col("total"), number).otherwise(0))
        .otherwise(F.coalesce("by_name", F.lit(0)))
    )
    return selectors.crossJoin(F.broadcast(total)).join(names, "selector", "left").select("selector", result.cast("long").alias("image_id"))


def name_in_use(selectors: DataFrame, images: DataFrame) -> DataFrame:
    known = images.select(F.col("image").alias("selector")).where("selector <> ''").distinct().withColumn("used", F.lit(True))
    return selectors.join(known, "selector", "left").select("selector", F.coalesce("used", F.lit(False)).alias("used"))


def literal_matches(wanted: DataFrame, entries: DataFrame, ignore_case: bool = False) -> DataFrame:
    """wanted(path) with the entry each finds: exact where there is one, else (ignoring case) the first by path; null if none."""
    exact = entries.select("path", F.col("path").alias("found"))
    out = wanted.join(exact, "path", "left")
    if not ignore_case:
        return out
    folded = entries.groupBy(F.upper("path").alias("key")).agg(F.min("path").alias("near"))
    return out.withColumn("key", F.upper("path")).join(folded, "key", "left").select("path", F.coalesce("found", "near").alias("found"))


def ambiguous(entries: DataFrame) -> DataFrame:
    """Folded paths that several entries of an image share, which a case-insensitive lookup refuses."""
    return entries.groupBy("image", F.upper("path").alias("folded")).agg(F.count_distinct("path").alias("names")).where("names > 1")


def ambiguous_on_the_way(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """wanted(path) whose lookup without case meets two entries at some level: path and the folded prefix where it does first.

    entries(path) hold each directory; paths meet the levels by their own folded prefixes, an equi-join.
    """
    level = entries.groupBy(F.upper("path").alias("prefix")).agg(F.count_distinct("path").alias("names")).where("names > 1").select("prefix")
    steps = F.split(F.upper("path"), "/")
    own = wanted.select("path", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(steps), F.lit(2))), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).alias("prefix"))
    return own.join(level, "prefix").groupBy("path").agg(F.min_by("prefix", F.length("prefix")).alias("prefix"))


def glob_matches(entries: DataFrame, globs: list[str], ignore_case: bool = False, need_match: bool = False) -> DataFrame:
    """Entries whose path matches one of the globs, wildcards staying within a component."""
    if not globs:
        return entries.limit(0)
    out = entries.where(reduce(Column.__or__, [F.col("path").rlike(glob_pattern(g, ignore_case)) for g in globs]))
    if need_match and out.isEmpty():
        raise ArchiveError("glob_had_no_matches", str(globs))
    return out


def normalised_selection(paths: DataFrame, roots: DataFrame, ancestors: bool = True) -> DataFrame:
    """Paths selected by roots(path): each root that is there, all below it, and the directories above it unless not wanted.

    A path is joined with the roots by its own prefixes, an equi-join: the work grows with the depth of paths, not with paths times roots.
    Directories near the top lie above most paths, so the levels that hold few roots (BROAD at most) are broadcast and their
    prefixes are never dealt out; the others are, against roots that are a plain shuffle, so that Spark can split the paths of a root.
    A root below another one adds nothing to what that one selects.
    """
    own = roots.select("path").distinct()
    level = F.when(F.col("path") == "/", 0).otherwise(F.size(F.split("path", "/")) - 1)
    held = own.groupBy(level.alias("level")).agg(F.count("*").alias("n")).withColumn("so_far", F.sum("n").over(Window.orderBy("level")))
    broad = F.broadcast(held.where(F.col("so_far") <= BROAD).agg(F.coalesce(F.max("level"), F.lit(-1)).alias("broad")))

    few = own.crossJoin(broad).where(level <= F.col("broad")).select(F.col("path").alias("root"))
    many = own.crossJoin(broad).where(level > F.col("broad")).select(F.col("path").alias("root")).hint("rebalance")
    placed, way, n = paths.crossJoin(broad), _upward(F.col("path")), F.col("broad") + 1
    below = (
        placed.select("path", F.explode(F.slice(way, F.lit(1), n)).alias("root")).join(F.broadcast(few), "root", "left_semi").select("path")
        .unionByName(placed.select("path", F.explode(F.slice(way, n + 1, F.size(F.split("path", "/")))).alias("root")).join(many, "root", "left_semi").select("path"))
    )
    if not ancestors:
        return below.distinct()
    above = own.select(F.explode(F.filter(_upward(F.col("path")), lambda x: x != F.col("path"))).alias("path")).distinct().join(paths, "path", "left_semi")
    return below.unionByName(above).distinct()


def _upward(p: Column) -> Column:
    """The directories on the way to a path, the root first and the path itself last."""
    steps = F.split(p, "/")
    way = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: F.when(i == 0, F.lit("/")).otherwise(F.array_join(F.slice(steps, 1, i + 1), "/")))
    return F.when(p == "/", F.array(F.lit("/"))).otherwise(way)


def excluded(path: Column, exclusions: list[str], exceptions: list[str], ignore_case: bool = False) -> Column:
    """Whether the path or a directory above it matches an exclusion and no exception (a scan does not enter an excluded directory)."""
    steps = F.split(path, "/")
    chain = F.transform(F.sequence(F.lit(2), F.greatest(F.size(steps), F.lit(2))), lambda i: F.array_join(F.slice(steps, 1, i), "/"))

    def one(p: Column) -> Column:
        out = reduce(Column.__or__, [p.rlike(exclusion_pattern(x, False, ignore_case)) for x in exclusions], F.lit(False))
        back = reduce(Column.__or__, [p.rlike(exclusion_pattern(x, True, ignore_case)) for x in exceptions], F.lit(False))
        return out & ~back

    return F.exists(chain, one)


def captured(entries: DataFrame, exclusions: list[str], exceptions: list[str] = (), ignore_case: bool = False) -> DataFrame:
    return entries.where(~excluded(F.col("path"), list(exclusions), list(exceptions), ignore_case))


def needed(blobs: DataFrame, entries: DataFrame) -> DataFrame:
    """Blobs that a selection of entries needs; the others are skipped."""
    return blobs.join(entries.select("hash"), "hash", "left_semi")


