"""Frames as a stream give what the same frames give at once."""

import datetime
import hashlib

from vaultframe import streaming


def test_wanted_frames(spark, tmp_path):
    digest = lambda b: hashlib.sha1(b).hexdigest()
    at = datetime.datetime(2024, 1, 1)
    rows = [(0, "part", 1, None, None, at), (1, "blob", 1, digest(b"a"), bytearray(b"a"), at), (2, "blob", 1, digest(b"b"), bytearray(b"b"), at), (3, "blob", 2, digest(b"a"), bytearray(b"a"), at), (4, "blob", 2, digest(b"c"), bytearray(b"!"), at)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], streaming.FRAME).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    wanted = spark.createDataFrame([(digest(b"a"),), (digest(b"c"),)], "hash string")
    seen = []
    for recover in (False, True):
        stream = spark.readStream.schema(streaming.FRAME).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        name = f"got{int(recover)}"
        q = streaming.wanted_frames(stream, wanted, recover).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        seen.append(spark.table(name))
    assert [r["hash"] for r in seen[0].collect()] == [digest(b"a")]
    assert sorted((r["hash"], r["sound"]) for r in seen[1].collect()) == sorted([(digest(b"a"), True), (digest(b"c"), False)])
    assert [r["hash"] for r in streaming.outstanding(wanted, seen[0]).collect()] == [digest(b"c")]


def test_parts_and_progress_equal_batch(spark, tmp_path):
    rows = [(0, "part", 1, None, None)] + [(i, "blob", 1 + i // 4, str(i), bytes(i)) for i in range(1, 8)] + [(8, "part", 2, None, None)]
    folder = str(tmp_path / "in")
    for r in rows:
        spark.createDataFrame([(*r, datetime.datetime(2026, 1, 1, 0, r[0] // 3))], streaming.FRAME).write.mode("append").parquet(folder)

    def run(made, name, mode):
        q = made(streaming.frames(spark, folder, 1)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        assert q.awaitTermination(120)
        return spark.table(name)

    whole = spark.read.schema(streaming.FRAME).parquet(folder)
    assert sorted(map(tuple, run(streaming.parts_seen, "parts", "complete").collect())) == sorted(map(tuple, streaming.parts_seen(whole).collect())) == [
        (1, 3, 6, 0, 3, True), (2, 4, 22, 4, 8, True)
    ]
    assert sorted(map(tuple, run(streaming.progress, "seen", "complete").collect())) == sorted(map(tuple, streaming.progress(whole).collect()))
