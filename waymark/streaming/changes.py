"""A store of records kept up to date by a folder of change files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.registers import first_of
from waymark.operators.sites import apply_snapshot
from waymark.sources import versions


def latest_changes(changes: DataFrame, key: str) -> DataFrame:
    """The last change of each key: changes have `at` and `seq`, which tells changes of one moment apart."""
    return first_of(changes, [key], [F.desc("at"), F.desc("seq")])


def merged(store: DataFrame, changes: DataFrame, key: str, values: list[str], seen_at: str, keep: list[str] = ()) -> DataFrame:
    """The store (key, values, first_seen, last_seen, gone_at) after changes (key, values, deleted, at, seq): the last of each key counts. One full outer join for each batch; what a batch doesn't name stays."""
    last = latest_changes(changes, key)
    there = apply_snapshot(store, last.where("not deleted").select(key, *values), key, values, seen_at, incremental=True, keep=keep)
    gone = last.where("deleted").select(key, F.to_timestamp_ntz(F.lit(seen_at)).alias("__gone"))
    return there.join(gone, key, "left").withColumn("gone_at", F.coalesce("gone_at", "__gone")).drop("__gone")


def follow_folder(spark: SparkSession, changes: str, schema: str, store: str, checkpoint: str, key: str, values: list[str], keep: list[str] = ()):
    """Merges each batch of new change files (Parquet) into the store (a folder of `versions`), then stops when there are no more. A batch rewrites the buckets of the keys that it names; one that is run again finds the version that it made."""

    def step(batch: DataFrame, number: int) -> None:
        at = batch.agg(F.date_format(F.max("at"), "yyyy-MM-dd HH:mm:ss")).first()[0]
        if at:
            versions.change(batch, key, store, lambda rows, told: merged(rows, told, key, values, at, keep), token=f"{checkpoint}#{number}")

    stream = spark.readStream.schema(schema).parquet(changes)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
