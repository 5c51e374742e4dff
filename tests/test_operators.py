"""Fixed cases of archive operators: results, refusals, edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from vaultframe import functions as fn
from vaultframe.errors import ArchiveError
from vaultframe.operators import blobs, images, layout, lookup, mutate, properties, select, tree, verify
from vaultframe.plans import Archive
from vaultframe.sources import files

ENTRY = "image string, path string, name string, inode long, attributes long, hash string, size long"


def entries(spark, rows):
    return spark.createDataFrame([(i, p, p.rsplit("/", 1)[1], n, 0x80, h, s) for i, p, n, h, s in rows], ENTRY)


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def test_image_stats_count_links(spark):
    e = entries(spark, [("1", "/first", 1, "a", 20), ("1", "/alias", 1, "a", 20), ("1", "/d/x", 2, "b", 21), ("2", "/x", 1, "a", 20)])
    got = {r["image"]: tuple(r)[1:] for r in images.image_stats(e).collect()}
    assert got == {"1": (2, 3, 61, 20), "2": (1, 1, 20, 0)}
    assert images.image_stats(entries(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("selector", "want"),
    [("all", -1), ("ALL", -1), ("*", -1), ("", 0), ("1", 1), (" +02", 2), ("3", 3), ("0", 1), ("Alpha", 3), ("alpha", 0), ("1 ", 0), ("4", 0), ("9" * 30, 0), (None, 0)],
)
def test_image_selector(spark, selector, want):
    known = spark.createDataFrame([(1, "0"), (2, "Beta"), (3, "Alpha")], "image_id int, image string")
    got = select.resolved_images(spark.createDataFrame([(selector,)], "selector string"), known)
    assert got.first()["image_id"] == want


def test_refusals(spark):
    e = entries(spark, [("1", "/a", 1, "a", 1)])
    for code, call in (
        (24, lambda: images.selected(e, ["1", "1"])), (18, lambda: images.selected(e, ["2"], {"1"})), (11, lambda: images.exported(e, e)),
        (24, lambda: images.joined_parts([], [])), (68, lambda: layout.split_parts(e, ["path"], 5, solid=True)), (24, lambda: layout.split_parts(e, ["path"], 0)),
        (62, lambda: images.joined_parts([{"guid": "g", "part_number": 1, "total_parts": 2}], [e])),
        (55, lambda: verify.missing_content(e, e.where("false"), strict=True)), (8, lambda: select.glob_matches(e, ["/z*"], need_match=True)),
        (14, lambda: files.exclusion_rules("[ExclusionList]\na/b")), (24, lambda: mutate.with_info(e, x=1)),
    ):
        with pytest.raises(ArchiveError) as caught:
            call()
        assert caught.value.code == code
    assert images.selected(e, []).count() == 0


TREE = [("/a", True), ("/a/x", False), ("/a/y", False), ("/b", True), ("/f", False)]


def test_paths_change(spark):
    t = spark.createDataFrame(TREE, "path string, is_dir boolean")
    paths = lambda df: sorted(r["path"] for r in df.collect())
    assert paths(mutate.deleted(t, "a", recursive=True)) == ["/b", "/f"]
    assert paths(mutate.deleted(t, "/none", force=True)) == sorted(p for p, _ in TREE)
    assert paths(mutate.deleted(t, "/", recursive=True)) == []
    assert paths(mutate.renamed(t, "/a", "/b")) == ["/b", "/b/x", "/b/y", "/f"]
    assert paths(mutate.renamed(t, "/f", "/a/x")) == ["/a", "/a/x", "/a/y", "/b"]
    assert paths(mutate.renamed(t, "/f", "/f")) == sorted(p for p, _ in TREE)
    for code, call in (
        (49, lambda: mutate.deleted(t, "/none")), (32, lambda: mutate.deleted(t, "/a")), (49, lambda: mutate.renamed(t, "/z", "/y")),
        (32, lambda: mutate.renamed(t, "/f", "/b")), (40, lambda: mutate.renamed(t, "/a", "/f")), (41, lambda: mutate.renamed(t, "/b", "/a")),
        (41, lambda: mutate.renamed(t, "/a", "/a/z")), (49, lambda: mutate.renamed(t, "/f", "/none/f")),
    ):
        with pytest.raises(ArchiveError) as caught:
            call()
        assert caught.value.code == code
    with pytest.raises(ArchiveError):  # nothing of a refused batch is kept: t is as it was
        mutate.updated(t, [("delete", "/f"), ("delete", "/none")])
    assert t.count() == 5


def test_overlay_clash_and_replace(spark):
    layers = spark.createDataFrame([(0, "/d", True, 1), (1, "/d", True, 2), (0, "/f", False, 3), (1, "/f", False, 4), (0, "/c", False, 5), (1, "/c", True, 6)], "layer int, path string, is_dir boolean, v int")
    kept, clash = images.overlay(layers)
    assert sorted((r["path"], r["v"]) for r in kept.collect()) == [("/d", 2), ("/f", 4)] and [r["path"] for r in clash.collect()] == ["/c"]
    assert sorted(r["path"] for r in images.overlay(layers, replace=False)[1].collect()) == ["/c", "/f"]


@pytest.mark.parametrize("seed", range(4))
def test_split_parts_as_one_loop(spark, seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 5, 40, 90, 100, 250]) for _ in range(r.choice([1, 7, 300]))]
    start = r.choice([0, 30])
    df = spark.createDataFrame(list(enumerate(sizes)), "at int, size long").repartition(5)
    got = [x["part"] for x in layout.split_parts(df, ["at"], 100, seed=start).orderBy("at").collect()]
    want, held, part = [], start, 1
    for s in sizes:
        if held and held + s >= 100:
            held, part = 0, part + 1
        held += s
        want.append(part)
    assert got == want


def test_exclusions_reach_below(spark):
    rules, back = files.exclusion_rules("[ExclusionList]\n; note\nC:\\tmp\n'*.log'\n[ExclusionException]\n\\tmp\\keep\\a\n[Other]\nx\n")
    assert rules == ["/tmp", "*.log"] and back == ["/tmp/keep/a"]
    df = spark.createDataFrame([(p,) for p in ("/tmp", "/tmp/keep", "/tmp/keep/a", "/tmp/keep/a/b", "/tmp/x", "/a.log", "/a.log/x", "/ok")], "path string")
    assert sorted(r["path"] for r in select.captured(df, rules, back).collect()) == ["/ok", "/tmp", "/tmp/keep", "/tmp/keep/a", "/tmp/keep/a/b"]


def test_reachable_and_order(spark):
    nodes = spark.createDataFrame([("r", None, ""), ("a", "r", "a"), ("b", "a", "B"), ("c", "b", "c"), ("lost", "gone", "x"), ("loop", "loop", "y"), ("x", "y", "x"), ("y", "x", "y"), ("z", "x", "z")], "node string, parent string, name string")
    got = {r["node"]: r["path"] for r in tree.reachable(nodes).collect()}
    assert got == {"r": "/", "a": "/a", "b": "/a/B", "c": "/a/B/c"}
    deep = spark.createDataFrame([(i, i - 1 if i else None, str(i)) for i in range(40)], "node long, parent long, name string")
    assert {r["node"]: r["path"] for r in tree.reachable(deep).collect()}[39] == "".join(f"/{i}" for i in range(1, 40))
    p = spark.createDataFrame([("/b",), ("/A",), ("/a",), ("/b/z",)], "path string")
    assert [r["path"] for r in tree.preorder(p).orderBy("walk").collect()] == ["/A", "/a", "/b", "/b/z"]


def test_lookup_records_round_trip(spark):
    rows = [("k", i, 2**40 + i, i % 256, 2**33 * i, 2**50 + i, 7 + i, 2**31 + i, None if i == 3 else f"{i + 1:040x}") for i in range(5)]
    df = spark.createDataFrame(rows, "archive string, row int, stored long, flags long, offset long, size long, part long, refs long, hash string")
    packed = df.withColumn("content", files.encoded_lookup(df)).orderBy("row").collect()
    whole = b"".join(bytes(r["content"]) for r in packed) + b"tail"
    got = files.lookup_rows(spark.createDataFrame([("k", bytearray(whole)), ("none", bytearray())], "archive string, content binary")).orderBy("row")
    assert [tuple(r[c] for c in df.columns) for r in got.collect()] == rows


def test_headers_and_directory(spark, tmp_path):
    body = bytearray(208)
    for (name, at, n), v in zip(files.HEADER_FIELDS, (208, 0x10D00, 0x20002, 32768, 1, 1, 3), strict=True):
        body[at : at + n] = v.to_bytes(n, "little")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(body)
    (tmp_path / "y.bin").write_bytes(b"12")
    rows = spark.createDataFrame([("p", body)], "path string, content binary")
    head = files.header_rows(rows).first()
    assert (head["version"], head["chunk_size"], head["image_count"]) == (0x10D00, 32768, 3)
    got = {r["path"]: r["size"] for r in files.directory_entries(spark, str(tmp_path)).collect()}
    assert got == {"/d/x.bin": 208, "/y.bin": 2}
    (tmp_path / "list").write_text(" /a \n# no\n\n'/b c'\n;x\n")
    assert [r["path"] for r in files.path_list(spark, str(tmp_path / "list")).collect()] == ["/a", "/b c"]


def test_functions(spark):
    assert one(spark, fn.canonical_path(F.col("x")), "\\a//b\\") == "/a/b" and one(spark, fn.canonical_path(F.col("x"))) == "/"
    assert one(spark, fn.part_name(F.lit("a.b.swm"), F.lit(2))) == "a.b2.swm" and one(spark, fn.part_name(F.lit("a"), F.lit(12))) == "a12"
    assert one(spark, fn.extension(F.lit("a.b/c"))) is None and one(spark, fn.extension(F.lit("a."))) == ""
    assert one(spark, fn.number_of(F.lit(" -12x"))) == -12 and one(spark, fn.number_of(F.lit("9" * 30))) == 0
    assert one(spark, fn.xml_unescape(fn.xml_escape(F.lit("<a & 'b'>")))) == "<a & 'b'>" and one(spark, fn.aligned(F.lit(9))) == 16
    for codec, low, high in (("XPRESS", 12, 16), ("LZX", 15, 21), ("LZMS", 15, 30)):
        sizes = [2**low, 2**high, 2 ** (low - 1), 2**low + 1]
        assert [one(spark, fn.valid_chunk(F.lit(codec), F.lit(n))) for n in sizes] == [True, True, False, False]
    assert one(spark, fn.next_report(F.lit(5), F.lit(1000))) == 15


def test_archive_value(spark):
    a = Archive.of(entries(spark, [("1", "/a", 1, "h1", 3)]))
    b = Archive.of(entries(spark, [("2", "/b", 1, "h1", 3), ("2", "/c", 2, "h2", 4)]))
    both = a.export(b)
    assert sorted((r["hash"], r["refs"]) for r in both.blobs.collect()) == [("h1", 2), ("h2", 1)] and a.entries.count() == 1
    assert both.select(["2"]).blobs.count() == 2
    content = spark.createDataFrame([("h1", bytearray(b"x"))], "hash string, bytes binary")
    assert [(r["fault"], r["hash"]) for r in both.verify(content).collect()] == [("corrupt", "h1")]
    assert blobs.missing_in(b.blobs, a.blobs).first()["hash"] == "h2"


def test_exclusion_lines():
    for bad in ("[ExclusionList", "[ExclusionList]\nC:x", "[ExclusionList]\nx\n[Other\n"):
        with pytest.raises(ArchiveError):
            files.exclusion_rules(bad)
    assert files.exclusion_rules("") == ([], [])
    assert files.exclusion_rules("x\n[exclusionlist]\r\n\n \"\\a b\\c\" \r\n# no\n'open\n[EXCLUSIONLIST]\nd:/e\\\\f") == (["/a b/c", "'open", "/e/f"], [])


def test_image_lists(spark):
    kind = "image string, description string, digest string"
    target, source = spark.createDataFrame([("a", "d", "1")], kind), spark.createDataFrame([("b", "e", "2")], kind)
    both, left = images.exported_images(target, source, no_descriptions=True, gift=True)
    assert sorted(map(tuple, both.collect())) == [("a", "d", "1"), ("b", "", "2")] and left.count() == 0
    for code, more in ((87, ("c", "", "1")), (11, ("a", "", "3"))):
        with pytest.raises(ArchiveError) as caught:
            images.exported_images(target, spark.createDataFrame([more], kind))
        assert caught.value.code == code
    known = spark.createDataFrame([(1, "a"), (2, "b")], "image_id int, image string")
    assert [tuple(r) for r in properties.with_name(known, 2, "").orderBy("image_id").collect()] == [(1, "a"), (2, "")]
    for code, call in ((11, lambda: properties.with_name(known, 2, "a")), (18, lambda: properties.with_name(known, 3, "c"))):
        with pytest.raises(ArchiveError) as caught:
            call()
        assert caught.value.code == code


def test_set_property_follows_what_is_there(spark):
    held = spark.createDataFrame([("1", "A/B", "x")], "image string, path string, value string")
    assert sorted(r["path"] for r in mutate.with_property(held, "1", "A/B[2]", "y").collect()) == ["A/B", "A/B[2]"]
    assert mutate.with_property(held, "1", "A/B", "").count() == 0
    with pytest.raises(ArchiveError):
        mutate.with_property(held, "1", "A/B[3]", "y")


def test_changes_while_captured(spark):
    before = spark.createDataFrame([("/a", "1", 1), ("/b", "2", 2)], "path string, hash string, size long")
    assert verify.concurrent_changes(before, before, strict=True).count() == 0
    with pytest.raises(ArchiveError) as caught:
        verify.concurrent_changes(before, before.where("path = '/a'"), strict=True)
    assert caught.value.code == 88


def test_referenced_tables(spark, tmp_path):
    spark.createDataFrame([("h", 3)], "hash string, size long").write.parquet(str(tmp_path / "x1"))
    assert files.referenced_tables(spark, str(tmp_path / "x*")).count() == 1
    assert files.referenced_tables(spark, str(tmp_path / "y*")).count() == 0
    with pytest.raises(ArchiveError) as caught:
        files.referenced_tables(spark, str(tmp_path / "y*"), need_match=True)
    assert caught.value.code == 8


def test_lookup_without_rows(spark):
    rows = spark.createDataFrame([], "row long, hash string, size long, flags long, part long, offset long, stored long")
    sizes = spark.createDataFrame([], "row long, resource_size long")
    assert lookup.data_rows(rows).count() == lookup.solid_rows(rows, sizes).count() == lookup.metadata_rows(rows, 3).count() == lookup.faults(rows).count() == 0
