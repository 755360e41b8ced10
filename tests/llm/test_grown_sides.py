"""Joins whose sides both grow with the corpus gather neither of them in the driver."""
import pytest
from pyspark.sql import functions as F

from codeweave.llm import common, components, simhash


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.mark.parametrize("bits", [2, 3])
def test_links_and_stars_broadcast_nothing(spark, tmp_path, bits):
    spark.range(2000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/fps")
    fps = spark.read.parquet(f"{tmp_path}/fps")  # Spark knows its size, and takes what is exploded from it for as small
    assert broadcasts(simhash.link(fps, bits, hot=3)) == 0
    edges = fps.select(F.col("fp").alias("u"), F.shiftright("fp", 1).alias("v"))
    assert broadcasts(components._star(edges, True)) == broadcasts(components._star(edges, False)) == 0


def test_documents_broadcast_nothing(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} is here and word{i % 3}") for i in range(40)], "doc_id long, text string")
    near = simhash.near_duplicates(docs)
    assert broadcasts(near) == 0 and near.count() == 40
    kept = near.select("doc_id", "txt")
    assert broadcasts(common.keep_rows(docs, kept)) == 0
