"""Poisson weights from digests against those from uniforms, and their weighted cells."""
from pyspark.sql import functions as F

from codeweave.functions.hashing import unit_uniform
from codeweave.operators import evaluate as E


def test_weights_agree(spark):
    d = spark.range(20000).select("id", F.substring(F.md5(F.concat(F.lit("29|"), F.col("id").cast("string"))), 1, 15).alias("h"))
    w = d.select(E.poisson_weight_of_digest(F.col("h")).alias("a"), E.poisson_weight(unit_uniform(29, "id")).alias("b"))
    assert w.filter("a <> b").count() == 0
    assert w.agg(F.max("a")).first()[0] >= 5
    ends = spark.createDataFrame([("0" * 15,), ("f" * 15,)], "h string").select(E.poisson_weight_of_digest(F.col("h")).alias("w"))
    assert [r["w"] for r in ends.collect()] == [0, 12]


def test_cells_are_dealt_and_sums_agree(spark):
    cells = spark.createDataFrame([(i, "ab"[i % 2], 1, i % 3 % 2) for i in range(50)] + [(None, "a", 0, 1)], "id long, label string, g int, p int")
    merged = cells.groupBy("id", "label").agg(F.max("g").alias("g"), F.max("p").alias("p"))  # AQE leaves one partition
    got = E.poisson_bootstrap_cells(merged, 30, 29)
    x = cells.crossJoin(spark.range(30).select(F.col("id").cast("int").alias("rep")))
    x = x.withColumn("w", E.poisson_weight(unit_uniform(29, "rep", "id")))
    want = x.groupBy("rep", "label").agg(F.sum(F.col("w") * F.col("g") * F.col("p")), F.sum(F.col("w") * (1 - F.col("g")) * F.col("p")),
                                         F.sum(F.col("w") * F.col("g") * (1 - F.col("p"))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "RepartitionByExpression" in got._jdf.queryExecution().optimizedPlan().toString()


def test_hashes_of_texts_are_stable_hashes(spark, monkeypatch):
    import hashlib

    from codeweave.functions import hashing as H
    monkeypatch.setattr(H, "TEXTS", 5)
    rests = [f"|{i}".encode() for i in (0, 7, 12, 99, 12345, 10 ** 17)] + [b"", b"|" + b"x" * 60]
    got = {}
    for rep, start, h in H.hashes_of_texts(29, 120, rests):
        got |= {(rep, start + i): x for i, x in enumerate(h.tolist())}
    assert got == {(rep, i): int(hashlib.md5(f"29|{rep}".encode() + x).hexdigest()[:15], 16) for rep in range(120) for i, x in enumerate(rests)}


def test_interval_reads_replicates_once(spark):
    m = spark.createDataFrame([(i, i / 10, i / 5, 1.0 - i / 10) for i in range(11)], "rep int, precision double, recall double, f1 double")
    ci = E.confidence_interval(m, 0.1, 0.9)
    assert {r["metric"]: (round(r["lo"], 9), round(r["hi"], 9)) for r in ci.collect()} == {"precision": (0.1, 0.9), "recall": (0.2, 1.8), "f1": (0.1, 0.9)}
    assert "Union" not in ci._jdf.queryExecution().optimizedPlan().toString()
