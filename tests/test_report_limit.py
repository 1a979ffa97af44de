"""The hourly limit: by spells of a device, and on a stream whose reports come out of order."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from waymark.streaming import reports

START = datetime(2024, 1, 1)


def plain(rows, most):
    out, kept = {}, {}
    for i, device, at in sorted(rows, key=lambda r: (r[2], r[0])):
        recent = [k for k in kept.get(device, []) if (at - k).total_seconds() < 3600]
        out[i] = len(recent) < most
        kept[device] = recent + [at] * out[i]
    return out


def made():
    rnd, rows = random.Random(6), []
    for device, (spells, many) in {"a": (4, 12), "b": (1, 60), "c": (9, 2), "d": (1, 1)}.items():
        at = START
        for _ in range(spells):
            at += timedelta(seconds=rnd.choice([3599, 3600, 3601, 9000]))
            for _ in range(many):
                at += timedelta(seconds=rnd.choice([0, 0, 30, 300, 719]), microseconds=rnd.choice([0, 1]))
                rows.append((len(rows), device, at))
    return rows


def test_spells_are_judged_apart(spark):
    rows = made()
    df = spark.createDataFrame(rows, "id long, reporter string, at timestamp")
    for most in (1, 5, 30):
        assert {r.id: r.allowed for r in reports.allowed(df, most).collect()} == plain(rows, most)
    assert reports.allowed(df.limit(0)).count() == 0
    assert {r.id: r.allowed for r in reports.allowed(df.withColumn("at", F.col("at").cast("timestamp_ntz")), 5).collect()} == plain(rows, 5)


def test_the_limit_as_a_stream(spark, tmp_path):
    rows, rnd = made(), random.Random(7)
    # reports come up to eight minutes out of order; a last one, much later, lets the watermark pass all others
    order = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rnd.uniform(0, 480)))
    order.append((9999, "z", max(r[2] for r in rows) + timedelta(hours=30)))
    for n, low in enumerate(range(0, len(order), 40)):
        spark.createDataFrame(order[low : low + 40], "id long, reporter string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}")
    stream = spark.readStream.schema("id long, reporter string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = reports.allowed_as_they_come(stream, 5, "10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(150)
    got = {r.id: r.allowed for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == plain(rows, 5)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1  # quiet devices are forgotten
