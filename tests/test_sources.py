"""Prepared tables and bundles."""
import os

from pyspark.sql import functions as F

from codeweave.sources import io as S


def test_prepared_table_is_read_rebuilt_and_mended(spark, tmp_path):
    src, place, calls = str(tmp_path / "in"), str(tmp_path / "prepared"), []
    spark.range(10).write.parquet(src)

    def get(version=""):
        df = spark.read.parquet(src)

        def build():
            calls.append(1)
            return df.agg(F.sum("id").alias("s"))
        return S.read_or_build(spark, place, build, [df], version).first()["s"]
    assert (get(), len(calls)) == (45, 1)
    assert (get(), len(calls)) == (45, 1)  # read
    assert (get("2"), len(calls)) == (45, 2)  # something else it depends on changed
    spark.range(10, 12).write.mode("append").parquet(src)
    assert (get(), len(calls)) == (66, 3)  # changed input
    new = max((os.path.join(place, d) for d in os.listdir(place)), key=os.path.getmtime)
    os.remove(os.path.join(new, "_SUCCESS"))
    assert (get(), len(calls)) == (66, 4)  # broken off
    assert (get(), len(calls)) == (66, 4)


def test_transcript_bundles(spark, tmp_path):
    turns = [(i, n, ["GP", "Patient"][n % 2], f"turn {n} of {i}\nnext: line \x1e é") for i in range(50) for n in range(1 + i % 4)] + [(99, 0, "GP", "")]
    df = spark.createDataFrame(turns, "id long, turn_no int, speaker string, utterance string").withColumn(
        "start", F.when(F.col("id") % 2 == 0, "2020-01-02 10:11:12").otherwise("2020-01-02")).withColumn("duration", F.lit("65"))
    path = str(tmp_path / "t")
    S.write_transcripts(df.repartition(3), path)
    files = [f for f in os.listdir(path + "/bundles") if f.startswith("part")]
    assert len(files) <= 8
    text = "".join(open(f"{path}/bundles/{f}", encoding="utf-8").read() for f in files)
    assert "3\n2020-01-02\n65\nGP\nturn 0 of 3 next: line   é\nPatient\n" in text
    back = sorted((int(r["id"]), r["turn_no"], r["speaker"], r["utterance"]) for r in S.read_transcripts(spark, path).collect())
    assert back == sorted((i, n, s, u.replace("\n", " ").replace("\x1e", " ")) for i, n, s, u in turns)
    some = S.read_transcripts(spark, path, ids=[3, 99, 12345])
    assert {r["id"] for r in some.collect()} == {"3", "99"} and len(some.inputFiles()) <= 2
    assert S.read_transcripts(spark, path, ids=[777]).collect() == []
    start = {r["id"]: str(r["start"]) for r in some.collect()}
    assert start == {"3": "2020-01-02 00:00:00", "99": "2020-01-02 00:00:00"}
