"""Joins of few rows look for no hot keys; those of more deal them out; both give the same rows."""

import pytest
from pyspark.sql import functions as F

from scorelake.llm import common


@pytest.mark.parametrize(("rows", "how", "dealt"), [(500, "inner", False), (500, "left", False), (6000, "inner", True)])
def test_few_rows_are_joined_as_they_are(spark, rows, how, dealt):
    left = spark.range(rows).select(F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id")).alias("key"), F.col("id").alias("by"))
    facts = left.where("key % 20 <> 9").groupBy("key").agg(F.count("*").alias("n"), F.max("by").alias("top"))
    made = common.join_hot(left, facts, "key", rows, "by", how)
    assert ("__salt" in made._jdf.queryExecution().analyzed().toString()) == dealt
    assert sorted(map(str, made.collect())) == sorted(map(str, left.join(facts.drop("n"), "key", how).collect()))
