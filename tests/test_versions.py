"""Versions that come into being in one step, squares that are pruned, files that have changed."""

import os
import time

import pytest
from pyspark.sql import functions as F

from waymark.sources import versions

SCHEMA = "k long, v string"


def held(df):
    return {r.k: r.v for r in df.collect()}


def test_replace_and_change(spark, tmp_path):
    store, rows = str(tmp_path / "t"), [(i, f"v{i}") for i in range(300)]
    with pytest.raises(FileNotFoundError):
        versions.read(spark, store)
    df = spark.createDataFrame([*rows, (None, None)], SCHEMA)
    assert versions.replace(df, "k", store) == 1 and held(versions.read(spark, store)) == {**dict(rows), None: None}
    assert versions.replace(df.repartition(7).orderBy(F.desc("k")), "k", store) == 1  # the same rows, in another order
    pinned = versions.read(spark, store)
    put = lambda rows, told: rows.join(told.select("k"), "k", "left_anti").unionByName(told.where("v is not null").select("k", "v"))
    told = spark.createDataFrame([(5, "five"), (1000, "new"), (7, None)], SCHEMA)
    before = versions.manifest(spark, store, 1)["parts"]
    assert versions.change(told, "k", store, put, token="b1") == 2
    after = versions.manifest(spark, store, 2)["parts"]
    assert sum(before[b] != after.get(b) for b in before) <= 3 and len(before) > 40  # what no change names isn't written again
    want = {**dict(rows), None: None, 5: "five", 1000: "new"}
    want.pop(7)
    assert held(versions.read(spark, store)) == want and held(pinned) == {**dict(rows), None: None} and held(versions.read(spark, store, 1))[7] == "v7"
    assert versions.change(told, "k", store, put, token="b1") == 2 and versions.change(told.limit(0), "k", store, put) == 2
    assert versions.replace(spark.createDataFrame([], SCHEMA), "k", store) == 3 and held(versions.read(spark, store)) == {}
    assert versions.replace(df, "k", store) == 4
    versions.forget(spark, store, keep=1)
    assert held(versions.read(spark, store)) == {**dict(rows), None: None} and len(os.listdir(tmp_path / "t" / "data")) == 1


def test_a_writer_that_dies_and_two_at_once(spark, tmp_path, monkeypatch):
    store, df = str(tmp_path / "t"), spark.createDataFrame([(1, "a")], SCHEMA)
    versions.replace(df, "k", store)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "_published", dies)  # after its data are written
        with pytest.raises(KeyboardInterrupt):
            versions.replace(spark.createDataFrame([(1, "b"), (2, "c")], SCHEMA), "k", store)
    assert versions.current(spark, store) == 1 and held(versions.read(spark, store)) == {1: "a"}

    def slow(rows, told):
        versions.change(told, "k", store, lambda r, t: r, token="other")  # another writer gets in between
        return rows

    with pytest.raises(RuntimeError, match="meanwhile"):
        versions.change(df, "k", store, slow)
    assert versions.current(spark, store) == 2 and held(versions.read(spark, store)) == {1: "a"}
    assert versions.replace(spark.createDataFrame([(1, None)], SCHEMA), "k", store) == 3 and versions.replace(spark.createDataFrame([(1, "")], SCHEMA), "k", store) == 4  # null is no empty text


def test_squares_are_pruned(spark, tmp_path):
    sites = spark.range(2000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 90 / 10 - 4.5).alias("lat"), (F.col("id") % 70 / 10 - 3.5).alias("lng"))
    versions.write_squares(sites, str(tmp_path / "s"))
    box = (-1.5, -0.5, 0.25, 1.0)
    found = versions.read_squares(spark, str(tmp_path / "s"), box)
    assert {r.key for r in found.collect()} == {r.key for r in sites.where("lng between -1.5 and 0.25 and lat between -0.5 and 1.0").collect()}
    assert "PartitionFilters: [isnotnull(sq_lat" in found._jdf.queryExecution().executedPlan().toString()
    squares = [r for r in spark.read.parquet(str(tmp_path / "s")).select("sq_lat", "sq_lng").distinct().collect()]
    assert len(squares) > 50 and found.select("sq_lat", "sq_lng").distinct().count() <= 9


def test_changed_files(spark, tmp_path):
    for n in range(3):
        (tmp_path / "in" / str(n)).mkdir(parents=True)
        (tmp_path / "in" / str(n) / "a.csv").write_text(f"x{n}")
    read = spark.createDataFrame(versions.listed_files(spark, str(tmp_path / "in")).collect())
    assert read.count() == 3 and versions.unread_files(versions.listed_files(spark, str(tmp_path / "in")), read).count() == 0
    (tmp_path / "in" / "1" / "a.csv").write_text("longer")
    os.utime(tmp_path / "in" / "2" / "a.csv", (time.time() + 5, time.time() + 5))
    (tmp_path / "in" / "3.csv").write_text("new")
    left = versions.unread_files(versions.listed_files(spark, str(tmp_path / "in")), read).collect()
    assert sorted(r.path.split("/in/")[1] for r in left) == ["1/a.csv", "2/a.csv", "3.csv"]
