"""Output in slices: a stopped run goes on, what it left half-written is replaced."""

import glob
import os
import shutil

from mendral.sources import resume

SCHEMA = "k long, v string, index long"


def rows_of(spark, path):
    return sorted((r["index"], r.k, r.v) for r in resume.read_slices(spark, path, SCHEMA).collect())


def test_index_is_the_place_in_the_order(spark):
    rows = spark.createDataFrame([((i * 37) % 101, f"v{i}") for i in range(101)], "k long, v string")
    assert sorted((r["index"], r.k) for r in resume.indexed(rows, ["k"]).collect()) == [(i, i) for i in range(101)]
    assert resume.indexed(rows.limit(0), ["k"]).count() == 0
    assert {r.k for r in resume.index_slice(resume.indexed(rows, ["k"]), 10, 13).collect()} == {10, 11, 12}


def test_a_stopped_run_goes_on(spark, tmp_path):
    rows = resume.indexed(spark.createDataFrame([(i, f"v{i}") for i in range(100)], "k long, v string"), ["k"])
    path, whole = str(tmp_path / "out"), str(tmp_path / "whole")
    assert resume.write_slices(rows, whole, 10, batch=100) == 1
    assert resume.write_slices(rows, path, 10, batch=3, most=2) == 2
    assert len(rows_of(spark, path)) == 60
    # killed in the middle of a batch: one slice is complete without an entry, one has a part of its rows
    rows.where("index BETWEEN 60 AND 69 OR index BETWEEN 70 AND 73").selectExpr("k", "'torn' AS v", "index", "index div 10 AS slice").write.mode("append").partitionBy("slice").parquet(path)
    assert len(rows_of(spark, path)) == 60
    assert resume.write_slices(rows, path, 10, batch=3) == 2
    assert rows_of(spark, path) == rows_of(spark, whole) == [(i, i, f"v{i}") for i in range(100)]
    assert resume.write_slices(rows, path, 10) == 0


def test_changed_rows_are_written_again(spark, tmp_path):
    path = str(tmp_path / "out")
    make = lambda x: resume.indexed(spark.createDataFrame([(i, x if i == 25 else "a") for i in range(40)], "k long, v string"), ["k"])
    resume.write_slices(make("a"), path, 10)
    kept = {os.path.basename(f) for f in glob.glob(f"{path}/slice=1/*.parquet")}
    assert resume.write_slices(make("b"), path, 10) == 1
    assert rows_of(spark, path)[25] == (25, 25, "b")
    assert {os.path.basename(f) for f in glob.glob(f"{path}/slice=1/*.parquet")} == kept
    shutil.rmtree(path)
