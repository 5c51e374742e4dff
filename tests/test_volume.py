"""What queries send through shuffles: rows of the largest task, bytes of all tasks."""

from contextlib import contextmanager

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from vaultframe.operators import select, tree
from vaultframe.queries import QUERIES


@contextmanager
def settings(spark, **conf):
    keys = {"partitions": "spark.sql.shuffle.partitions", "adaptive": "spark.sql.adaptive.enabled", "broadcast": "spark.sql.autoBroadcastJoinThreshold"}
    before = {keys[k]: spark.conf.get(keys[k]) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(keys[k], v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def traffic(spark, df, group):
    """Rows that the largest task reads from shuffles, and bytes that all tasks write to them, while df is computed."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    rows = df.collect()
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    most = written = 0
    for stage in stages:
        tasks = store.taskList(stage, 0, 10_000)
        for i in range(tasks.size()):
            held = tasks.apply(i).taskMetrics()
            if held.isDefined():
                most = max(most, held.get().shuffleReadMetrics().recordsRead())
                written += held.get().shuffleWriteMetrics().bytesWritten()
    return rows, most, written


@pytest.mark.parametrize("broad", [select.BROAD, 1, 0])
def test_selection_deals_out_no_directory_above_most_paths(spark, monkeypatch, broad):
    monkeypatch.setattr(select, "BROAD", broad)
    ids = spark.range(4000)
    paths = ids.select(F.concat(F.lit("/d/"), F.col("id").cast("string"), F.lit("/x")).alias("path")).unionByName(spark.createDataFrame([("/",), ("/d",), ("/d/7",)], "path string"))
    roots = ids.where("id % 2 = 0").select(F.concat(F.lit("/d/"), F.col("id").cast("string")).alias("path")).unionByName(spark.createDataFrame([("/none",), ("/d/8/x",), ("/d/9/x",)], "path string"))
    with settings(spark, partitions="16", adaptive="false", broadcast="-1"):
        rows, most, _ = traffic(spark, select.normalised_selection(paths, roots), f"selection-{broad}")
    assert sorted(r["path"] for r in rows) == sorted(["/", "/d", "/d/9/x", *[f"/d/{i}/x" for i in range(0, 4000, 2)]])
    if broad > 1:
        assert most < 2000


def test_canonical_counts_sorts_no_walk_and_reads_lines_once_for_streams(spark):
    plan = QUERIES["canonical_counts"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "transform(" in line and "Aggregate" not in line]
    assert sum("l_linenumber" in line and "Relation" in line for line in plan) <= 3


def test_dir_entries_shuffles_hashes_in_half_their_length(spark):
    e = spark.range(0, 20_000, 1, 4).select(
        F.lit("1").alias("image"), F.concat(F.lit("/"), F.col("id").cast("string")).alias("path"), F.col("id").alias("inode"),
        F.when(F.col("id") == 1, "Ab").when(F.col("id") == 2, "abc").when(F.col("id") == 3, "").when(F.col("id") != 4, F.sha1(F.col("id").cast("string").cast("binary"))).alias("hash"), F.lit(1).cast("long").alias("size"),
    )
    blobs = e.where("inode <> 7").select("hash", "size")
    with settings(spark, adaptive="false", broadcast="-1"):
        rows, _, written = traffic(spark, tree.dir_entries(e, blobs), "dir_entries")
    assert len(rows) == 20_000 and [r["path"] for r in rows if r["missing"]] == ["/7"]
    assert {r["path"]: r["hash"] for r in rows} == {r["path"]: r["hash"] for r in e.collect()}
    assert written < 2_400_000
