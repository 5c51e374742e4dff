"""Changes of a tree or its properties. Relations are immutable: each operation returns the new rows or refuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.errors import ArchiveError
from vaultframe.functions import within


def _plain(path: str) -> str:
    return "/" + "/".join(x for x in path.replace("\\", "/").split("/") if x)


def _has_children(paths: DataFrame, root: str) -> bool:
    return not paths.where(within(F.col("path"), F.lit(root)) & (F.col("path") != root)).isEmpty()


def deleted(entries: DataFrame, path: str, recursive: bool = False, force: bool = False) -> DataFrame:
    """Without a path and all below it. Absence is refused unless forced, a directory unless recursive; the root empties the tree."""
    path = _plain(path)
    found = not entries.where(within(F.col("path"), F.lit(path))).isEmpty()
    if not found:
        if force:
            return entries
        raise ArchiveError("path_does_not_exist", path)
    if not recursive and _has_children(entries, path):
        raise ArchiveError("is_directory", path)
    return entries.where(~within(F.col("path"), F.lit(path)))


def moved(path: Column, old: str, new: str) -> Column:
    """path with the prefix old replaced."""
    at = F.lit(old)
    return F.when(path == at, F.lit(new)).when(within(path, at), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def renamed(entries: DataFrame, old: str, new: str) -> DataFrame:
    """Everything at or below old moves to new; a file that is there is replaced. entries(path, is_dir, ...)."""
    old, new = _plain(old), _plain(new)
    source = entries.where(F.col("path") == old).first()
    implied = source is None and _has_children(entries, old)
    if source is None and not implied:
        raise ArchiveError("path_does_not_exist", old)
    if old == new:
        return entries
    if new.startswith(old.rstrip("/") + "/"):
        raise ArchiveError("not_empty", "a directory cannot move below itself")
    is_dir = implied or source["is_dir"]
    target = entries.where(F.col("path") == new).first()
    filled = _has_children(entries, new)
    if (target is not None and target["is_dir"]) or filled:
        if not is_dir:
            raise ArchiveError("is_directory", new)
        if filled:
            raise ArchiveError("not_empty", new)
    elif target is not None and is_dir:
        raise ArchiveError("not_a_directory", new)
    above = new.rsplit("/", 1)[0] or "/"
    if above != "/" and entries.where(F.col("path") == above).first() is None and not _has_children(entries, above):
        raise ArchiveError("path_does_not_exist", above)
    return entries.where(F.col("path") != new).withColumn("path", moved(F.col("path"), old, new))


def added(entries: DataFrame, tree: DataFrame, at: str, replace: bool = True) -> DataFrame:
    """entries with a tree placed at a path: directories merge, a file replaces a file, a file and a directory clash."""
    from vaultframe.operators.images import overlay

    at = _plain(at).rstrip("/")
    placed = tree.withColumn("path", F.when(F.col("path") == "/", at or "/").otherwise(F.concat(F.lit(at), F.col("path"))))
    both, clashes = overlay(entries.withColumn("layer", F.lit(0)).unionByName(placed.withColumn("layer", F.lit(1))), replace)
    if (bad := clashes.first()) is not None:
        raise ArchiveError("is_directory" if bad["clash"] == "directory and file" else "invalid_overlay", bad["path"])
    return both.drop("layer").select(*entries.columns)


def updated(entries: DataFrame, commands: list[tuple]) -> DataFrame:
    """Commands in order: ("add", tree, path), ("delete", path, {options}), ("rename", old, new). All hold or, if one is refused, none."""
    from vaultframe.operators.settling import settle

    now = entries
    for verb, *args in commands:
        options = args.pop() if args and isinstance(args[-1], dict) else {}
        if verb == "add":
            now = added(now, *args, **options)
        elif verb == "delete":
            now = deleted(now, *args, **options)
        elif verb == "rename":
            now = renamed(now, *args, **options)
        else:
            raise ArchiveError("invalid_param", verb)
        now = settle(now)
    return now


def with_property(properties: DataFrame, image: str, path: str, value: str) -> DataFrame:
    """properties(image, path, value) with one set, or deleted by an empty value. An ordinal A[n] may follow what is there, no farther."""
    step = path.rsplit("[", 1)
    if len(step) == 2 and value:
        number = int(step[1].rstrip("]"))
        held = properties.where((F.col("image") == image) & F.col("path").rlike("^" + "".join("\\" + c if c in "\\.^$|?*+()[]{}" else c for c in step[0]) + r"(\[[0-9]+\])?$")).count()
        if number > held + 1:
            raise ArchiveError("invalid_param", path)
    rest = properties.where(~((F.col("image") == image) & (F.col("path") == path)))
    if not value:
        return rest
    return rest.unionByName(properties.sparkSession.createDataFrame([(image, path, value)], "image string, path string, value string"))


def with_info(archive: DataFrame, **changes) -> DataFrame:
    """Archive rows with header fields (guid, boot_index, flags) replaced."""
    known = {"guid", "boot_index", "flags", "chunk_size", "compression"}
    if unknown := set(changes) - known:
        raise ArchiveError("invalid_param", str(unknown))
    return archive.withColumns({k: F.lit(v).cast(archive.schema[k].dataType) for k, v in changes.items()})


