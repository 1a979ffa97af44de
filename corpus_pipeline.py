"""A training corpus from documents, in five stages. Each function takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bin_packing, partenum_join, pii_surrogates, quality_classifier, quality_rules
from waymark.llm import queries as q
from waymark.llm.common import shared_folder

#: The stages' contents are models and hashes; they are tested against brute force.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, keeps."""
    forest = quality_classifier.learn(docs, q.table(spark, sf_dir, "labels"), q.remainder(5) != 0)
    return quality_classifier.score(docs, forest).where(F.col("score") >= 0.3).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return partenum_join.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the new text."""
    replaced = pii_surrogates.replace(docs, q.SECRET)
    return replaced.withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces, packed into sequences of at most 1024 tokens."""
    pieces = bin_packing.token_pieces(docs, q.VOCABULARY, q.PATTERN, end_id=2, capacity=1024, short_first=True)
    return bin_packing.pack(pieces, 1024, salt=["doc_id", "piece", "ids_crc32"])


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_duplicates", near_duplicates), ("pii", private), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written as Parquet in the shared folder and read again."""
    docs, folder = q.table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
