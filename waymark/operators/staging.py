"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset: a folder of this machine in local mode (tests), an error on a cluster, whose executors couldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: later uses don't compute it again, and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node that edges(a, b) connect each node with. Min-labels with pointer jumping, so the rounds grow with the logarithm of the longest path; each is staged."""
    both = staged(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        fresh = staged(low.join(jump, "root").select("node", "old", F.least("root", "up").alias("root")), f"{name}-{step}")
        if fresh.where("root <> old").isEmpty():
            return fresh.select("node", "root")
        labels = fresh.select("node", "root")
