"""What grids and folds store and rank: totals are bounded, a document is stored once."""
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeweave.operators import keyed as K
from codeweave.plans import experiments as X


@pytest.mark.parametrize("parts", [1, 3])
def test_vocabulary_of_folds_and_keys(spark, monkeypatch, parts):
    monkeypatch.setattr(K, "TERM_PARTS", parts)
    r = random.Random(4)
    rows = [(st, i, f"t{r.randrange(30)}", r.randint(1, 5), i % 3) for st in ("a", "b") for i in range(40) for _ in range(3)]
    c = spark.createDataFrame(rows, "key string, id long, term string, tf long, fold int")
    n = spark.createDataFrame([(f"{st}|{cv}", 20) for st in "ab" for cv in (0, 2)], "key string, n long")
    got = {(x["key"], x["term"]): x["idf"] for x in K.fold_vocabulary(c, [0, 2], n, 5).collect()}
    whole = {(x["key"], x["term"]) for x in K.vocabulary(c, n.select(F.substring("key", 1, 1).alias("key"), "n").distinct(), 5).collect()}

    def best(some):
        total, df = Counter(), Counter()
        for _, _, t, tf, _ in some:
            total[t] += tf
            df[t] += 1
        return {t: math.log(21 / (df[t] + 1)) + 1 for t in sorted(total, key=lambda t: (-total[t], t))[:5]}
    want = {(f"{st}|{cv}", t): idf for st in "ab" for cv in (0, 2) for t, idf in best([x for x in rows if x[0] == st and x[4] != cv]).items()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    assert whole == {(st, t) for st in "ab" for t in best([x for x in rows if x[0] == st])}


def test_folds_store_a_document_once(spark, tmp_path, monkeypatch):
    r = random.Random(6)
    words = [f"word{i}" for i in range(12)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 8))), r.choice(["en", "de"]), "src1") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sizes, write = {}, X.written

    def kept(df, name="table", *a):
        out = write(df, name, *a)
        sizes[name] = out.count()
        return out
    monkeypatch.setattr(X, "written", kept)
    folds = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, fold int")
    s = X.folds_setup(spark, str(tmp_path), folds, [0, 1, 2], ["ce"])
    names = {(x["key"], x["term"]): x["name"] for x in s.vocab.collect()}

    def terms(text):
        t = text.split()
        return Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])])
    for side, rows in (("train", s.train_x), ("test", s.test_x)):
        got = {(x["key"], x["id"], names[x["key"], x["term"]]): x["w"] for x in rows.collect()}
        want = {}
        for cv in range(3):
            df = Counter(t for i, text, _, _ in docs if i % 3 != cv for t in terms(text))
            for i, text, _, _ in docs:
                if (i % 3 != cv) == (side == "train"):
                    w = {t: n * (math.log(21 / (df[t] + 1)) + 1) for t, n in terms(text).items() if t in df}
                    length = math.sqrt(sum(v * v for v in w.values()))
                    want |= {(f"ce|{cv}", i, t): v / length for t, v in w.items()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    assert "folds-train" not in sizes and sizes["folds-bags"] <= len(docs)


def test_scenarios_cut_each_text_once(spark, tmp_path, monkeypatch):
    from codeweave.plans import q_experiments as Q
    r = random.Random(5)
    docs = [(i, "\n".join(" ".join(r.choices(["aa", "bb", "cc", "dd"], k=4)) for _ in range(3)), ["en", "de", "fr"][i % 3], "src1") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    calls, count = [], X.term_counts_by
    monkeypatch.setattr(X, "term_counts_by", lambda *a, **k: calls.append(1) or count(*a, **k))
    assert Q.r03(spark, str(tmp_path)).count() == 12
    assert len(calls) == 4


def test_vectors_of_several_settings_in_one_batch(spark):
    idfs = spark.createDataFrame([("s", "s|0", [1.0, 2.0]), ("t", "t|0", [1.0, 1.0, 3.0, None, 1.0])], "setting string, key string, idfs array<double>")
    rows = [("s", ["s|0"], 1, [(0, 3), (1, 2)], "a"), ("t", ["t|0"], 1, [(4, 3), (3, 5), (2, 1)], "a"), ("s", ["s|0"], 2, [], "b"), ("t", ["t|0"], 2, [(0, 1)], None)]
    bags = spark.createDataFrame(rows, "setting string, keys array<string>, id long, bag array<struct<t:int,tf:bigint>>, label string").coalesce(1)
    v = K.Vectors(bags, idfs)
    want = {(r["key"], r["id"], r["term"]): r["w"] for r in v.long().collect()}
    packed = {(key, r["id"], t): w for key in ("s|0", "t|0") for r in v.packed(key).collect() for t, w in zip(r["ts"], r["ws"])}
    assert len(want) == 5 and want.keys() == packed.keys() and all(abs(want[x] - packed[x]) < 1e-12 for x in want)
    sums = {(r["key"], r["label"], r["term"]): r["n_ct"] for r in v.label_sums().collect()}
    assert sums.keys() == {("s|0", "a", 0), ("s|0", "a", 1), ("t|0", "a", 4), ("t|0", "a", 2), ("t|0", None, 0)}
    assert v.packed("s|0").count() == 2


def test_ids_that_come_twice_keep_their_rows(spark, tmp_path):
    docs = [(i % 20, f"aa bb w{i % 7} w{i % 5} cc", ["en", "de"][i % 2], "src1") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    folds = spark.createDataFrame([(i % 20, i % 3) for i in range(40)], "id long, fold int")
    s = X.folds_setup(spark, str(tmp_path), folds, [0, 1, 2], ["ce"])
    assert s.train_v is None and s.test_v is None and s.predict(["centroid"]).count() > 0
