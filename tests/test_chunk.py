"""Packing of units that come as rows against the in-row packing."""
import random

from pyspark.sql import functions as F

from codeweave.functions.text import sentences
from codeweave.operators import chunk as C


def both(spark, units, max_tokens, blocks=None):
    """units: id -> texts."""
    rows = spark.createDataFrame([(i, p * 3, s) for i, us in units.items() for p, s in enumerate(us)], "id long, pos long, s string")
    arrays = spark.createDataFrame([(i, us) for i, us in units.items()], "id long, units array<string>")
    a = sorted(map(tuple, C.pack_rows(rows, max_tokens, blocks).select("id", "chunk_id", "text", "n_units").collect()))
    b = sorted(map(tuple, C.pack_units(arrays, ["id"], "units", max_tokens).select("id", "chunk_id", "text", "n_units").collect()))
    return a, b


def test_rows_are_packed_like_arrays(spark):
    r = random.Random(5)
    units = {i: [" ".join("w" * r.randint(1, 3) for _ in range(r.choice([0, 1, 2, 3, 5, 9, 14]))) for _ in range(r.randint(1, 30))] for i in range(40)}
    units[100] = [" ".join(["x"] * r.randint(1, 8)) for _ in range(700)]  # one document over many blocks
    units[101], units[102], units[103] = ["a " * 50], ["a " * 50, "b"], ["b", "a " * 10, "c " * 9, ""]
    for max_tokens, blocks in ((10, 9), (1, None)):
        a, b = both(spark, units, max_tokens, blocks)
        assert a == b


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), sentences(F.col("text")).alias("units"))
    rows = docs.select("id", F.posexplode("units").alias("pos", "s"))
    a = sorted(map(tuple, C.pack_rows(rows, 120).select("id", "chunk_id", "text", "n_units").collect()))
    b = sorted(map(tuple, C.pack_units(docs, ["id"], "units", 120).select("id", "chunk_id", "text", "n_units").collect()))
    assert a == b and len(a) > 100


def test_short_documents_take_one_shuffle(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i if i else None, p, " ".join("w" * r.randint(0, 9))) for i in range(12) for p in range(5 + 9 * (i % 3))]
    df = spark.createDataFrame(rows, "id long, pos long, s string")
    calls, scan = [], C.running
    monkeypatch.setattr(C, "running", lambda *a, **k: calls.append(1) or scan(*a, **k))
    known = df.filter("id is not null")
    near = sorted(map(tuple, C.pack_rows(known, 10).collect()))
    assert not calls
    assert sorted(map(tuple, C._pack_long(known, 10).collect())) == near
    assert sorted(map(tuple, C.pack_rows(known, 10, short=15).collect())) == near and calls  # long and short ones together
    assert sorted(map(str, map(tuple, C.pack_rows(df, 10).collect()))) == sorted(map(str, map(tuple, C._pack_long(df, 10).collect())))
