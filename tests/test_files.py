"""Files through data sources: point files with commit, a replayed folder with offsets and pace."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import FOLDER
from voxmill.catalog import runner, sources
from voxmill.catalog.streams import finish
from voxmill.sources import points, replay, text


def files_of(root):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names)


def body(spark, rows):
    return spark.createDataFrame(rows, "name string, at int, value string")


def test_a_point_file_has_header_and_lines_in_order(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    rows = [("b/1 x", i, f"{i} 0 0 1 2 3") for i in range(40)] + [("a", 7, "9 9 9 1 1 1")]
    points.write_point_files(body(spark, rows[::-1]), root, "name", F.col("at"))
    found = files_of(f"{tmp_path}/out")
    assert [os.path.basename(f) for f in found if not f.endswith(".crc")].count("_SUCCESS") == 1 and sum(f.endswith(".ply") for f in found) == 2
    big = next(f for f in found if f.endswith("x.ply"))
    lines = open(big).read().splitlines()
    assert lines[:3] == ["ply", "format ascii 1.0", "element vertex 40"] and lines[10:] == [r[2] for r in rows[:40]]
    read = text.parse_points(points.read_point_files(spark, root), "key")
    assert {(r.key, r.ix) for r in read.collect()} == {("b/1 x", i) for i in range(40)} | {("a", 9)}
    points.write_point_files(body(spark, rows[-1:]), root, "name", F.col("at"))            # overwrites
    assert sum(f.endswith(".ply") for f in files_of(f"{tmp_path}/out")) == 1


def test_a_long_point_file_is_whole_and_files_are_read_twice_at_most(spark, tmp_path):
    long = spark.range(200_000).select(F.lit("a b%").alias("name"), F.col("id").cast("int").alias("at"), F.format_string("%d %050d", "id", "id").alias("value"))
    points.write_point_files(long.unionByName(body(spark, [("z.ply", 0, "7 7 7")])), f"file://{tmp_path}/out", "name", F.col("at"))
    got = points.read_point_files(spark, f"file://{tmp_path}/out").groupBy("key").agg(F.count("value").alias("n"), F.max(F.when(F.col("value").startswith("element"), F.col("value"))).alias("said"))
    assert {tuple(r) for r in got.collect()} == {("a b%", 200_010, "element vertex 200000"), ("z.ply", 11, "element vertex 1")}
    df = runner("voxel_files")(spark, FOLDER)
    assert 1 <= df._jdf.queryExecution().optimizedPlan().toString().count("Relation [value") <= 2


def test_documents_stand_in_a_folder_a_task(spark, tmp_path, monkeypatch):
    class T:
        pass
    T.spark = spark
    monkeypatch.setattr(sources, "scratch", lambda spark: f"file://{tmp_path}/docs")
    docs = spark.createDataFrame([(k, '{"k": "é %s"}' % k) for k in [*range(64), None]], "room int, value string")
    got = sources.through_files(T, docs, "room").collect()
    assert {(r.room, r.value.strip()) for r in got} == {(k, '{"k": "é %s"}' % k) for k in [*range(64), None]} and len(got) == len({r.file for r in got}) == 65
    assert sum(len(dirs) for _, dirs, _ in os.walk(f"{tmp_path}/docs")) <= 8


def test_a_failed_write_leaves_the_old_files(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    points.write_point_files(body(spark, [("a", 0, "1 1 1 1 1 1")]), root, "name", F.col("at"))
    before = files_of(f"{tmp_path}/out")
    bad = body(spark, [(f"n{i}", 0, str(i)) for i in range(50)]).withColumn("value", F.when(F.col("name") == "n33", F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no"):
        points.write_point_files(bad, root, "name", F.col("at"))
    assert files_of(f"{tmp_path}/out") == before
    points.write_point_files(body(spark, []), root, "name", F.col("at"))
    assert [f for f in files_of(f"{tmp_path}/out") if f.endswith(".ply")] == []


def test_replay_goes_on_from_its_offset(spark, tmp_path):
    for i in range(3):
        spark.range(5).select((F.col("id") + 10 * i).alias("frame")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    root, slow = str(tmp_path), dict(rounds=4, fps=1.5, clock=f"file://{tmp_path}/clock")
    first = finish(replay.replay(spark, f"file://{root}/in", "frame long", **slow), root).count()
    assert 0 < first < 60 and first % 5 == 0
    time.sleep(8.5)
    got = finish(replay.replay(spark, f"file://{root}/in", "frame long", **slow), root).collect()
    assert sorted((r.turn, r.place, r.frame) for r in got) == [(t, i, 10 * i + k) for t in range(4) for i in range(3) for k in range(5)]
    with pytest.raises(Exception, match="clock"):
        finish(replay.replay(spark, f"file://{root}/in", "frame long", fps=1.0), f"{root}/other")
