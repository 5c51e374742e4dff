"""Directories, path lists, exclusion configurations and binary record files as relations."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.errors import ArchiveError
from vaultframe.sources.adapters import FILE


def directory_entries(spark: SparkSession, root: str, image: str = "1", glob: str = "*") -> DataFrame:
    """Files below root (any file system that Spark reads) as dentry rows; bytes are hashed where they are read.

    Files without bytes hold no content and are left out, as Spark's file readers do.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace("path", "^[a-z]+:/+", "/")
    below = F.concat(F.lit("/"), F.substring_index(path, root.rstrip("/") + "/", -1))
    return files.select(
        F.lit(image).alias("image"), below.alias("path"), F.regexp_extract(below, "([^/]*)$", 1).alias("name"), F.xxhash64("path").alias("inode"),
        F.lit(FILE).cast("long").alias("attributes"), F.sha1("content").alias("hash"), F.col("length").alias("size"), F.col("modificationTime").alias("written"),
    )


def path_list(spark: SparkSession, file: str, encoding: str = "UTF-8") -> DataFrame:
    """Paths of a list file: trimmed lines without blanks, comments (# or ;) and matching quotes."""
    lines = spark.read.option("encoding", encoding).text(file).select(listed_path(F.col("value")).alias("path"))
    return lines.where("path is not null")


def listed_path(line: Column) -> Column:
    bare = F.regexp_replace(F.trim(F.regexp_replace(line, "^﻿", "")), r"^[\s]+|[\s]+$", "")
    bare = F.regexp_replace(bare, r"^(['\"])(.*)\1$", "$2")
    return F.when((bare != "") & ~bare.rlike("^[#;]"), F.regexp_replace(bare, "\x00.*$", ""))


#: A rule: quotes around all of it, a drive before a separator and what follows a NUL do not count.
_RULE = re.compile(r"""(?P<quote>["']?)(?:.:(?=[/\\]))?(?P<rule>[^\0]*?)(?:\0.*)?(?P=quote)""")


def exclusion_rules(text: str) -> tuple[list[str], list[str]]:
    """(exclusions, exceptions) of a configuration text; it is small and parsed where the plan is made.

    Sections of other names are passed over. A section without its bracket, a drive without a separator and a relative
    path of several components are refused.
    """
    head, *rest = re.split(r"(?m)^[^\S\n]*\[([^\]\n]*)\].*$", text)
    sections = list(zip(map(str.lower, rest[::2]), rest[1::2], strict=True))
    if open_ := re.search(r"(?m)^[^\S\n]*\[.*$", "\n".join([head, *rest[1::2]])):
        raise ArchiveError("invalid_capture_config", open_[0])
    return tuple([rule for name, body in sections if name == wanted for rule in _rules(body)] for wanted in ("exclusionlist", "exclusionexception"))


def _rules(body: str) -> list[str]:
    lines = re.findall(r"(?m)^[^\S\n]*([^\s#;](?:[^\n]*\S)?)", body)
    rules = [re.sub(r"[/\\]+", "/", _RULE.fullmatch(line)["rule"]) for line in lines]
    if bad := [rule for rule in rules if re.match(".:|[^/]+/", rule)]:
        raise ArchiveError("invalid_capture_config", bad[0])
    return rules


def decoded_text(content: Column) -> Column:
    """Text of a file's bytes: UTF-16 in the order that its mark names, else UTF-8 with or without a mark."""
    mark = lambda n: F.hex(F.substring(content, 1, n))
    return (
        F.when(mark(2) == "FFFE", F.decode(F.substring(content, 3, 1 << 30), "UTF-16LE"))
        .when(mark(2) == "FEFF", F.decode(F.substring(content, 3, 1 << 30), "UTF-16BE"))
        .when(mark(3) == "EFBBBF", F.decode(F.substring(content, 4, 1 << 30), "UTF-8")).otherwise(F.decode(content, "UTF-8"))
    )


def referenced_tables(spark: SparkSession, glob: str, need_match: bool = False) -> DataFrame:
    """Blob rows (hash, size) of the parquet files that a glob names, to be passed to blobs.referenced_from."""
    try:
        return spark.read.parquet(glob).select("hash", "size")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        if need_match:
            raise ArchiveError("glob_had_no_matches", glob) from e
        return spark.createDataFrame([], "hash string, size long")


#: Fixed layout of a lookup record: field, first byte, bytes. A header's fields are laid out likewise.
RECORD = 50
LOOKUP_FIELDS = (("stored", 0, 7), ("flags", 7, 1), ("offset", 8, 8), ("size", 16, 8), ("part", 24, 2), ("refs", 26, 4))
HEADER_FIELDS = (
    ("header_size", 8, 4), ("version", 12, 4), ("flags", 16, 4), ("chunk_size", 20, 4), ("part_number", 40, 2), ("total_parts", 42, 2), ("image_count", 44, 4)
)


def little_endian(data: Column, start: Column | int, size: int) -> Column:
    """An unsigned little-endian number of at most eight bytes as a long."""
    first = F.lit(start) if isinstance(start, int) else start
    digits = F.concat(*[F.hex(F.substring(data, first + i + 1, F.lit(1))) for i in reversed(range(size))])
    return F.conv(digits, 16, -10).cast("long")


#: Fixed values of a header: its length, the first bytes of seekable and sequential archives, known versions.
HEADER, SEEKABLE, SEQUENTIAL = 208, "4D5357494D000000", "574C50574D000000"
VERSIONS = (0x10D00, 0xE00)


def header_rows(files: DataFrame) -> DataFrame:
    """Header fields of archives read as binaryFile rows (path, content).

    The header is at the beginning; a sequential archive repeats it at the end, complete there. fault names what makes
    a header unusable: a strange beginning, length or version, a part number beyond the parts, else null.
    """
    head = F.hex(F.substring("content", 1, 8))
    h = files.select(
        "path", head.alias("magic"), F.when(head == SEQUENTIAL, F.substring(F.col("content"), F.greatest(F.length("content") - HEADER + 1, F.lit(1)), F.lit(HEADER))).otherwise(F.substring("content", 1, HEADER)).alias("h")
    )
    c = F.col("h")
    h = h.select("path", "magic", *[little_endian(c, at, n).alias(f) for f, at, n in HEADER_FIELDS], F.hex(F.substring(c, 25, 16)).alias("guid"))
    fault = (
        F.when(~F.col("magic").isin(SEEKABLE, SEQUENTIAL), "not_an_archive").when(F.coalesce(F.col("header_size") != HEADER, F.lit(True)), "invalid_header")
        .when(~F.col("version").isin(*VERSIONS), "unknown_version").when((F.col("part_number") < 1) | (F.col("part_number") > F.col("total_parts")), "invalid_part_number")
    )
    return h.withColumn("fault", fault)


def encoded_header(rows: DataFrame, sequential: Column | None = None) -> Column:
    """The 208 bytes of a header row with the columns of header_rows; fields that it does not have are zero."""
    magic = F.when(F.coalesce(sequential, F.lit(False)), SEQUENTIAL).otherwise(SEEKABLE) if sequential is not None else F.lit(SEEKABLE)
    at, parts = 8, [magic]
    fields = {start: (_reversed_hex(F.col(f), n), n) for f, start, n in HEADER_FIELDS} | {24: (F.col("guid"), 16)}
    for start in sorted(fields):
        digits, n = fields[start]
        parts += [F.lit("00" * (start - at)), digits]
        at = start + n
    return F.unhex(F.concat(*parts, F.lit("00" * (HEADER - at))))


def _reversed_hex(number: Column, size: int) -> Column:
    digits = F.lpad(F.hex(number.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def lookup_rows(tables: DataFrame) -> DataFrame:
    """Rows of lookup tables given as (archive, content): position and fields of each whole record; hash is null if all zero."""
    many = F.floor(F.length("content") / RECORD).cast("int")
    one = tables.where(F.length("content") >= RECORD).select(
        "archive", F.posexplode(F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.substring(F.col("content"), i * RECORD + 1, F.lit(RECORD)))).alias("row", "r")
    )
    digest = F.lower(F.hex(F.substring("r", 31, 20)))
    return one.select("archive", "row", *[little_endian(F.col("r"), at, n).alias(f) for f, at, n in LOOKUP_FIELDS], F.nullif(digest, F.lit("0" * 40)).alias("hash"))


def encoded_lookup(rows: DataFrame) -> Column:
    """The 50 bytes of a lookup row with the columns of lookup_rows."""
    fields = [_reversed_hex(F.col(f), n) for f, _, n in LOOKUP_FIELDS]
    return F.unhex(F.concat(*fields, F.coalesce(rows["hash"], F.lit("0" * 40))))
