"""Column functions of archive relations; all are built from Spark's own functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed attribute bits and the distance of 1601-01-01 from 1970-01-01 in microseconds.
DIRECTORY, REPARSE, ENCRYPTED = 0x10, 0x400, 0x4000
EPOCH_MICROS = 11_644_473_600_000_000
#: Fixed flag bits of a header's compression and the chunk sizes (as powers of two) that each codec takes.
COMPRESSED, XPRESS, LZX, LZMS, XPRESS_ALT = 0x2, 0x20000, 0x40000, 0x80000, 0x200000
CHUNK_BITS = {"XPRESS": (12, 16), "LZX": (15, 21), "LZMS": (15, 30)}


def content_hash(text: Column) -> Column:
    """Identity of content: lower-case hexadecimal SHA-1."""
    return F.sha1(F.encode(text, "UTF-8"))


def digest_bytes(hash: Column) -> Column:
    """A hash as it travels through shuffles: lower-case hexadecimal text in half its length, any other text as it is; equal only for equal texts."""
    raw = F.unhex(hash)
    return F.when(F.lower(F.hex(raw)) == hash, F.concat(F.unhex(F.lit("01")), raw)).otherwise(F.concat(F.unhex(F.lit("00")), hash.cast("binary")))


def digest_text(digest: Column) -> Column:
    """The hash that digest_bytes was given."""
    rest = F.substring(digest, 2, 1 << 30)
    return F.when(F.substring(digest, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def content_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def has_bits(attributes: Column, bits: int) -> Column:
    return attributes.bitwiseAND(F.lit(bits).cast("long")) != 0


def is_directory(attributes: Column) -> Column:
    """Directories that are no reparse points, which is what path lookup may enter."""
    return has_bits(attributes, DIRECTORY) & ~has_bits(attributes, REPARSE)


def timestamp_of(ticks: Column) -> Column:
    """Ticks of 100 ns since 1601 (UTC) as a timestamp; the last digit is lost."""
    return F.timestamp_micros(F.floor(ticks / 10).cast("long") - EPOCH_MICROS)


def ticks_of(stamp: Column) -> Column:
    return (F.unix_micros(stamp) + EPOCH_MICROS) * 10


def compression_of(flags: Column) -> Column:
    """Codec name of header flags; null where the flags say compressed and name none."""
    return (
        F.when(~has_bits(flags, COMPRESSED), "NONE").when(has_bits(flags, LZX), "LZX")
        .when(has_bits(flags, XPRESS | XPRESS_ALT), "XPRESS").when(has_bits(flags, LZMS), "LZMS")
    )


def valid_chunk(codec: Column, size: Column) -> Column:
    """A codec's chunk is a power of two within its range; without a codec any size is."""
    size = size.cast("long")
    test = F.lit(False)
    for name, (low, high) in CHUNK_BITS.items():
        test = test | ((codec == name) & size.between(1 << low, 1 << high) & (size.bitwiseAND(size - 1) == 0))
    return (codec == "NONE") | test


def aligned(n: Column) -> Column:
    """n rounded up to a multiple of eight."""
    return F.floor((n.cast("long") + 7) / 8) * 8


def number_of(text: Column) -> Column:
    """A leading whole number, else 0; a number that does not fit is 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("long"), F.lit(0).cast("long"))


def canonical_path(path: Column) -> Column:
    """Both separators are one, runs collapse, one leads, none trails; null is the root."""
    clean = F.regexp_replace(F.coalesce(path, F.lit("")), r"[/\\]+", "/")
    return F.concat(F.lit("/"), F.trim(clean, F.lit("/")))


def part_name(name: Column, number: Column) -> Column:
    """File name of a part: the number stands before the last dot; part 1 keeps its name."""
    stem, dot = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return F.when(number == 1, name).otherwise(F.concat(stem, number.cast("string"), dot))


def extension(name: Column) -> Column:
    """What follows the last dot of the last component; null without a dot."""
    return F.when(name.rlike(r"\.[^./\\]*$"), F.regexp_extract(name, r"\.([^./\\]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_path(path: Column) -> Column:
    """Path of the directory above; null for the root."""
    return F.when(path != "/", F.coalesce(F.nullif(F.regexp_replace(path, r"/[^/]*$", ""), F.lit("")), F.lit("/")))


def depth(path: Column) -> Column:
    return F.when(path == "/", 0).otherwise(F.size(F.split(path, "/")) - 1).cast("long")


def within(path: Column, root: Column) -> Column:
    """path is root or lies below it."""
    return (root == "/") | (path == root) | path.startswith(F.concat(root, F.lit("/")))


def collation_key(name: Column) -> Column:
    """Sort key of names: upper case in UTF-16 units, then the units themselves."""
    units = lambda x: F.hex(F.encode(x, "UTF-16BE"))
    return F.struct(units(F.upper(name)).alias("folded"), units(name).alias("exact"))


def glob_pattern(glob: str, ignore_case: bool = False) -> str:
    """Regular expression of a path glob: * and ? stay within a component. ASCII letters fold if asked for."""
    body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in glob.replace("\\", "/"))
    return ("(?i)" if ignore_case else "") + "^" + body + "$"


def exclusion_pattern(rule: str, ancestors: bool = False, ignore_case: bool = False) -> str:
    """Regular expression of an exclusion rule. A rule with a leading separator is a path and holds for all below
    it; another is a base name. With ancestors (exceptions), a path rule also holds for the directories above it."""
    part = lambda x: "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in x)
    fold = "(?i)" if ignore_case else ""
    if not rule.startswith("/"):
        return f"{fold}(^|/){part(rule)}$"
    steps = [part(x) for x in rule.strip("/").split("/") if x]
    full = f"{fold}^/{'/'.join(steps)}(/.*)?$"
    if not ancestors:
        return full
    above = "".join(f"(/{x}" for x in steps[:-1]) + ")?" * len(steps[:-1])
    return f"{full}|{fold}^{above}/?$"


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def xml_unescape(text: Column) -> Column:
    for a, b in (("'", "&apos;"), ('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def next_report(done: Column, total: Column) -> Column:
    """Bytes at which progress is reported next: a hundredth on, at most 1 GiB on, at most the total."""
    return F.least(done + F.floor(total / 100), done + F.lit(1 << 30), total)


def property_of(xml: Column, path: str) -> Column:
    """First text at a property path A/B[2]/C (the n-th child of a name, from 1) below the document's element; null if there is none."""
    return F.nullif(F.xpath_string(xml, F.lit("/*/" + path)), F.lit(""))


def tagged_item(items: Column, tag: int, least: int = 0) -> Column:
    """The first of items (array of tag, data) with that tag and at least so many bytes; null if there is none."""
    return F.get(F.filter(items, lambda x: (x["tag"] == tag) & (F.octet_length(x["data"]) >= least)), F.lit(0))


def equal_within(a: Column, b: Column, most: int = 0) -> Column:
    """Both are null, or they differ by at most `most` (clocks of coarser file systems)."""
    return F.coalesce(F.abs(a - b) <= most, a.isNull() & b.isNull())
