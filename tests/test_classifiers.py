"""kNN and SVM on sparse rows against plain versions; one-pass grid features against single settings."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweave.operators import knn, svm_sparse

LABELS = ["a", "b", "c"]


def documents(r, n, first):
    out = {}
    for i in range(first, first + n):
        terms = {f"t{int(r.paretovariate(0.6)) % 40}": r.randint(1, 4) for _ in range(r.randint(0, 9))}
        norm = math.sqrt(sum(v * v for v in terms.values()))
        out[i] = {t: v / norm for t, v in terms.items()}
    return out


def long_rows(spark, docs):
    return spark.createDataFrame([(i, t, w) for i, d in docs.items() for t, w in d.items()], "id long, term string, w double")


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(9)
    train, test = documents(r, 150, 0), documents(r, 60, 1000)
    for i in range(200, 240):
        train[i] = dict(train[3])  # copies
    test[2000], test[2001], test[2002] = dict(train[3]), {}, {"unknown": 1.0}
    labels = {i: r.choice(LABELS) for i in train}
    return train, test, labels


@pytest.mark.parametrize("look", [0, 16])
def test_knn_equals_all_pairs(spark, data, look, monkeypatch):
    monkeypatch.setattr(knn, "LOOK", look)
    train, test, labels = data
    ids = spark.createDataFrame([(0, i) for i in train], "key int, id long")
    asked = spark.createDataFrame([(0, i) for i in test], "key int, id long")
    got = knn.nearest(long_rows(spark, train).select(F.lit(0).alias("key"), "*"), ids, long_rows(spark, test).select(F.lit(0).alias("key"), "*"), asked, 3)
    found = {}
    for x in got.collect():
        found.setdefault(x["id"], []).append((x["dist"], x["rid"]))
    for q, terms in test.items():
        every = sorted((max(0.0, round(1 - sum(w * train[i].get(t, 0.0) for t, w in terms.items()), 9)), i) for i in train)[:3]
        assert [(round(a, 7), b) for a, b in sorted(found[q])] == [(round(a, 7), b) for a, b in every], q


def test_knn_classes(spark, data):
    train, test, labels = data
    y = spark.createDataFrame(list(labels.items()), "id long, label string")
    got = knn.knn_sparse(long_rows(spark, train), y, spark.createDataFrame([(i,) for i in test], "id long"), long_rows(spark, test)).collect()
    by = {}
    for x in got:
        by.setdefault(x["id"], []).append(x)
    assert set(by) == set(test)
    assert all(sum(x["pred"] for x in xs) == 1 and abs(sum(x["score"] for x in xs) - 1) < 1e-6 for xs in by.values())
    # an exact match takes all the weight: the three smallest copies
    want = [labels[i] for i in sorted(i for i in train if train[i] == train[3])[:3]]
    assert {x["label"]: round(x["score"], 6) for x in by[2000]} == {lab: round(want.count(lab) / 3, 6) for lab in set(want)}


def optimum(z, y, c):
    """Newton's method for one class."""
    w = np.zeros(z.shape[1])
    for _ in range(200):
        gap = np.maximum(0, 1 - y * (z @ w))
        on = gap > 0
        g = w - 2 * c * (y * gap) @ z
        step = np.linalg.solve(np.eye(len(w)) + 2 * c * z[on].T @ z[on], g)
        if np.linalg.norm(g) < 1e-10:
            break
        f, t = w @ w / 2 + c * (gap ** 2).sum(), 1.0
        while True:
            v = w - t * step
            if v @ v / 2 + c * (np.maximum(0, 1 - y * (z @ v)) ** 2).sum() <= f or t < 1e-9:
                break
            t /= 2
        w = v
    return w


def test_svm_reaches_the_optimum_of_every_class(spark, data):
    train, test, labels = data
    two = [(i, lab) for i, lab in labels.items()] + [(i, "c") for i in list(labels)[:40]]
    y = spark.createDataFrame(two, "id long, label string").distinct()
    x = long_rows(spark, train)
    gamma = svm_sparse.scale(x, len(train), 40)
    z = svm_sparse.project(x, y, gamma, 24, 5).cache()
    names, model = svm_sparse.fit(z, y, 2.0, 400, 1e-7)
    assert names == LABELS
    rows = {r["id"]: np.array(r["z"]) for r in z.collect()}
    b = svm_sparse.offsets(24, 5)
    for i, terms in train.items():
        u = sum((w * svm_sparse.direction(t, 24, 5) for t, w in terms.items()), np.zeros(24))
        assert np.allclose(rows[i][:-1], np.sqrt(2 / 24) * np.cos(np.sqrt(2 * gamma) * u + b)) and rows[i][-1] == 1
    for k, name in enumerate(names):
        have = {i for i, lab in two if lab == name}
        ids = sorted(rows)
        best = optimum(np.array([rows[i] for i in ids]), np.array([1.0 if i in have else -1.0 for i in ids]), 2.0)
        assert np.allclose(model[k], best, atol=2e-4)


def test_projection_approximates_the_kernel():
    r = random.Random(2)
    a, b = documents(r, 2, 0).values()
    n, gamma = 20_000, 0.7
    u, v = (np.sqrt(2 * gamma) * sum((w * svm_sparse.direction(t, n, 1) for t, w in d.items()), np.zeros(n)) + svm_sparse.offsets(n, 1) for d in (a, b))
    exact = math.exp(-gamma * sum((a.get(t, 0) - b.get(t, 0)) ** 2 for t in {*a, *b}))
    assert abs(2 / n * (np.cos(u) @ np.cos(v)) - exact) < 0.03


def test_svm_decision_rules(spark, data):
    train, test, labels = data
    y = spark.createDataFrame(list(labels.items()), "id long, label string")
    ids = spark.createDataFrame([(i,) for i in test], "id long")
    args = (long_rows(spark, train), y, ids, long_rows(spark, test), 40)
    one = svm_sparse.svm(*args, features=16).collect()
    several = svm_sparse.svm(*args, several=True, features=16).collect()
    margin = {(x["id"], x["label"]): x["score"] for x in one}
    assert len(margin) == len(several) == 3 * len(test)
    for i in test:
        best = min((-margin[i, lab], lab) for lab in LABELS)[1]
        assert [x["label"] for x in one if x["id"] == i and x["pred"]] == [best]
    for x in several:
        p = 1 / (1 + math.exp(-margin[x["id"], x["label"]]))
        assert abs(x["score"] - p) < 1e-3 and (x["pred"] == (x["score"] > 0.1))


def test_keyed_methods_equal_single_runs(spark, data):
    from codeweave.operators import classify as M
    from codeweave.operators import keyed as K
    train, test, labels = data
    x, t = long_rows(spark, train), long_rows(spark, test)
    y = spark.createDataFrame(list(labels.items()), "id long, label string")
    ids = spark.createDataFrame([(i,) for i in test], "id long")
    vocab = x.select("term").distinct()
    half = F.col("id") % 2 == 0

    def keyed(df, flt=True):
        a = df.withColumn("key", F.lit("all"))
        return a.unionByName(df.filter(half).withColumn("key", F.lit("even"))) if flt else a.unionByName(df.withColumn("key", F.lit("even")))
    kx, ky, kv = keyed(x), keyed(y), x.select("term", "id").transform(keyed).select("key", "term").distinct()
    got = K.predict(["mnb", "bnb", "centroid", "knn"], kx, ky, keyed(ids, False), keyed(t, False).join(kv, ["key", "term"], "left_semi"), kv).collect()
    for key, flt in (("all", F.lit(True)), ("even", half)):
        for method in ("mnb", "bnb", "centroid", "knn"):
            v = x.filter(flt).select("term").distinct()
            want = M.classify(method, x.filter(flt), y.filter(flt), ids, t.join(v, "term", "left_semi"), v).collect()
            a = {(r["id"], r["label"]): (r["pred"], round(r["score"], 7)) for r in want if r["score"] or r["pred"]}
            b = {(r["id"], r["label"]): (r["pred"], round(r["score"], 7)) for r in got if r["key"] == key and r["method"] == method and (r["score"] or r["pred"])}
            assert a == b, (method, key)


def test_codes_of_a_document_are_united_either_way(spark):
    from codeweave.operators import relate as J
    r = random.Random(3)
    pred = [(r.randrange(30), r.choice("abcdefg")) for _ in range(200)] + [(99, None), (98, "unknown")]
    links = [(x, str(r.randrange(12))) for x in "abcdef" for _ in range(4)] + [("a", "Z")]
    p, m = spark.createDataFrame(pred, "id long, label string"), spark.createDataFrame(links, "label string, code string")
    want = sorted({(i, c) for i, x in pred for y, c in links if x == y and c != "Z"})
    for most in (1000, 3):
        assert sorted(map(tuple, J.fine_to_coarse(p, m, map_labels=most).select("id", "label").collect())) == want
    assert J.fine_to_coarse(p, m.limit(0)).collect() == []


def test_svm_takes_few_passes_either_way(spark, data, monkeypatch):
    train, _, labels = data
    x = long_rows(spark, train)
    y = spark.createDataFrame(list(labels.items()), "id long, label string")
    z = svm_sparse.project(x, y, 1.0, 16, 5).cache()
    calls, count = [], svm_sparse.losses
    monkeypatch.setattr(svm_sparse, "losses", lambda *a: calls.append(1) or count(*a))
    names, model = svm_sparse.fit(z, y, 2.0, 150, 1e-6)
    assert 0 < len(calls) <= 15
    monkeypatch.setattr(svm_sparse, "CURVED", 0)
    other = svm_sparse.fit(z, y, 2.0, 400, 1e-6)
    assert other[0] == names and np.allclose(model, other[1], atol=1e-3)
    packed = x.groupBy("id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("ws"))
    again = {r["id"]: r["z"] for r in svm_sparse.project(packed, y, 1.0, 16, 5).collect()}
    assert len(again) > 100 and all(np.allclose(again[r["id"]], r["z"]) for r in z.collect() if r["id"] in again)
    assert abs(svm_sparse.scale(packed, 150, 40) - svm_sparse.scale(x, 150, 40)) < 1e-9
