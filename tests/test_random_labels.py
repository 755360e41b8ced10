"""Fair-coin labels against the hash they are defined by, and their macro scores."""
import pytest
from pyspark.sql import functions as F

from codeweave.functions.hashing import stable_hash
from codeweave.operators import evaluate as E
from codeweave.operators import sample as S


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "a"), (3, "a"), (None, "b")], "id long, label string")


def test_flags_are_the_last_bit_of_the_hash(spark, docs):
    m = S.random_labels(docs.select("id").distinct(), ["a", "b", None], 40, 31)
    assert m.count() == 4 * 3 * 40
    assert m.filter(F.col("flag") != (stable_hash(31, "rep", "id", "label") % 2).cast("int")).count() == 0


def test_flags_are_dealt_to_all_cores(spark, docs):
    m = S.random_labels(docs.groupBy("id").agg(F.max("label").alias("x")).select("id"), ["a"], 5, 31)
    assert m.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_macro_of_cells_shuffles_no_cell(spark, docs):
    gold = docs.groupBy("id").agg(F.collect_set(F.struct("label")).alias("gold"))
    g = F.exists("gold", lambda x: x["label"].eqNullSafe(F.col("label"))).cast("int")
    cells = S.random_labels(gold, ["a", "b", None], 20, 31, {"g": g}).select("rep", "label", "g", F.col("flag").alias("p"))
    got = {r["rep"]: r for r in E.per_rep_macro(cells).collect()}
    flags = {(r["rep"], r["id"], r["label"]) for r in S.random_labels(docs.select("id").distinct(), ["a", "b", None], 20, 31).filter("flag = 1").collect()}
    truth = {(r["id"], r["label"]) for r in docs.collect()}
    for rep in range(20):
        f1 = []
        for label in ("a", "b", None):
            pos = {i for i, x in truth if x == label}
            said = {i for r, i, x in flags if r == rep and x == label}
            f1.append(2 * len(pos & said) / (len(pos) + len(said)))
        assert got[rep]["f1"] == pytest.approx(sum(f1) / 3)
