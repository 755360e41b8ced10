"""Terms counted in Arrow batches."""
from pyspark.sql import functions as F

from codeweave.operators import vectorize as V


def test_terms_of_a_vocabulary_only(spark, monkeypatch):
    monkeypatch.setattr(V, "COUNTED_ROWS", 3)
    docs = spark.createDataFrame([(1, "Aa bb aa, bb x the Ünï Ünï", "l"), (None, "bb the bb", "m"), (3, None, "l"), (4, "", None)], "id long, text string, label string")
    got = sorted(map(str, map(tuple, V.term_counts(docs, "id", "text", ["the"], keep=["label"]).collect())))
    assert got == sorted(map(str, [(1, "l", "aa", 2), (1, "l", "bb", 2), (1, "l", "ünï", 2), (1, "l", "aa bb", 2), (1, "l", "bb aa", 1), (1, "l", "bb ünï", 1),
                                   (1, "l", "ünï ünï", 1), (None, "m", "bb", 2), (None, "m", "bb bb", 1)]))
    some = V.term_counts(docs, "id", "text", ["the"], keep=["label"], only=["bb", "aa bb", "zz"])
    assert sorted(map(str, map(tuple, some.collect()))) == sorted(x for x in got if "'bb'" in x or "'aa bb'" in x)
    both = V.term_counts_by(docs, "id", "text", {"n": [], "t": ["the", "bb"]}, ["label"])
    assert sorted(r["term"] for r in both.filter(F.col("key") == "t").collect()) == ["aa", "aa aa", "aa ünï", "ünï", "ünï ünï"]


def test_scoring_counts_vocabulary_terms_only(spark, tmp_path, monkeypatch):
    from codeweave.plans import experiments as X
    docs = [(i, f"aa bb w{i} cc", ["en", "de"][i % 2], "src1") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    asked, count = [], X.term_counts
    monkeypatch.setattr(X, "term_counts", lambda *a, **k: asked.append(k.get("only")) or count(*a, **k))
    s = X.distant_setup(spark, str(tmp_path))
    assert s.terms in asked and set(s.terms) == {r["term"] for r in s.vocab.collect()} and s.vocab_size == len(s.terms)


def test_chunks_are_packed_and_scored_once(spark, tmp_path, monkeypatch):
    from codeweave.plans import q_experiments as Q
    docs = [(i, f"Aa bb. Cc w{i}! Dd aa?", ["en", "de"][i % 2], "src1") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sizes, write = {}, Q.written
    monkeypatch.setattr(Q, "written", lambda df, name="table", *a: sizes.setdefault(name, write(df, name, *a)))
    assert Q.r10(spark, str(tmp_path)).count() == 1
    assert sizes["chunks"].count() == 24 and sizes["merged"].select("id").distinct().count() == 24


def test_density_of_more_cells_than_an_int_holds(spark):
    w = spark.createDataFrame([(1, "aa", 0.5), (2, "bb", 0.5)], "id long, term string, w double")
    assert V.density(w, 500_000, 5000).first()["density"] == 2 / (500_000 * 5000)
    assert V.density(w, 2, 2).first()["density"] == 0.5
