"""Plan-shape regressions for the scale-critical operators."""
import re

from codeweave.operators import vectorize as V


def _formatted(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def _nodes(plan):
    return re.findall(r"^\(\d+\) (\w+)", plan, re.M)


def test_term_counting_needs_no_shuffle(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma beta %d" % i) for i in range(64)],
                                 "doc_id long, text string").repartition(8)
    base = _nodes(_formatted(spark, docs)).count("Exchange")
    plan = _formatted(spark, V.term_counts(docs, "doc_id", "text", ["gamma"]))
    assert _nodes(plan).count("Exchange") == base  # nothing beyond the input's own repartition


def test_tfidf_scan_is_pruned(spark):
    plan = _formatted(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
                      .transform(lambda d: V.term_counts(d, "doc_id", "text", [])))
    schemas = re.findall(r"ReadSchema: (struct<.*)", plan)
    assert schemas and all(s == "struct<doc_id:bigint,text:string>" for s in schemas)
