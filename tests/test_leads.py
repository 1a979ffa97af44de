"""What is dear is worked out once for each record: nothing of it moves below a filter, or above the rows that it is asked for."""

from pyspark.sql import functions as F

from waymark.functions import judges
from waymark.plans.judge_queries import classified_features

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tags_are_read_once_for_each_feature(spark):
    assert plan(classified_features(spark, SF)).count("str_to_map(") == 1


def test_leads_keep_rows_that_are_judged(spark):
    rows = spark.createDataFrame([(1, "x", 2), (2, None, 3)], "id int, a string, b int")
    j = F.when(F.col("a").isNotNull(), F.struct(F.col("a").alias("kind"), F.col("b").alias("weight")))
    assert [tuple(r) for r in rows.select("id", judges.leads(j)).collect()] == [(1, "x", 2)]
    assert [(r.id, r.b, r.j.kind) for r in judges.with_lead(rows, j).collect()] == [(1, 2, "x")]
