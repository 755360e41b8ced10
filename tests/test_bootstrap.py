"""Bootstrap by splitting over outcomes: the law of n draws with replacement."""
import numpy as np
import pytest

from pyspark.sql import functions as F

from codeweave.operators import evaluate as E


@pytest.mark.parametrize("fan", [256, 3])
def test_outcomes_have_the_law_of_draws(spark, fan, monkeypatch):
    monkeypatch.setattr(E, "FAN", fan)
    m = np.array([500, 300, 1, 60, 139, 200, 7, 93])
    df = spark.createDataFrame([(f"o{i}", int(x)) for i, x in enumerate(m)], "o string, m long")
    reps, n = 3000, int(m.sum())
    got = E.multinomial_outcomes(df, reps, 11).collect()
    w = np.zeros((reps, len(m)))
    for r in got:
        w[r["rep"], int(r["o"][1:])] = r["w"]
    assert (w.sum(axis=1) == n).all()
    p = m / n
    cov = n * (np.diag(p) - np.outer(p, p))
    assert np.all(np.abs(w.mean(axis=0) - n * p) < 5 * np.sqrt(np.diag(cov) / reps))
    sd = np.sqrt(np.diag(cov))
    assert np.all(np.abs(np.cov(w.T) - cov) < 6 * np.outer(sd, sd) / np.sqrt(reps))
    again = E.multinomial_outcomes(df, reps, 11).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_interval_agrees_with_index_draws(spark):
    rng = np.random.default_rng(3)
    gold = [(i, "ab"[i % 2]) for i in range(400)]
    pred = [(i, lab if rng.random() < 0.8 else "a") for i, lab in gold if rng.random() < 0.9]
    g, p = spark.createDataFrame(gold, "id long, label string"), spark.createDataFrame(pred, "id long, label string")
    ids = spark.createDataFrame([(i,) for i in range(420)], "id long")  # some have neither
    a = {r["metric"]: (r["lo"], r["hi"]) for r in E.confidence_interval(E.bootstrap_metrics(g, p, ids, 2000, 5)).collect()}
    cells = E.doc_cells(g, p, ids)
    b = {r["metric"]: (r["lo"], r["hi"]) for r in E.confidence_interval(E.macro(E.prf(E.bootstrap_cells(cells, E.bootstrap_draws(spark, 420, 2000, 5))), "rep")).collect()}
    for k in a:
        assert abs(a[k][0] - b[k][0]) < 0.01 and abs(a[k][1] - b[k][1]) < 0.01


def test_empty(spark):
    assert E.multinomial_outcomes(spark.createDataFrame([], "o string, m long"), 5, 1).collect() == []


def test_draws_are_counted_without_a_shuffle(spark, monkeypatch):
    from codeweave.functions.hashing import hashes_of_numbers, stable_hash
    want = [r[0] for r in spark.range(95, 1203).select(stable_hash(29, F.lit(7), "id")).collect()]
    assert hashes_of_numbers("29|7|", 95, 1203).tolist() == want
    got = E.bootstrap_draws(spark, 130, 9, 29)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    near = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(E, "COUNTED", 50)
    assert near == sorted(map(tuple, E.bootstrap_draws(spark, 130, 9, 29).collect())) and sum(w for _, _, w in near) == 9 * 130


@pytest.mark.parametrize("kinds", [1 << 16, 1])
def test_sums_are_those_of_the_draws(spark, monkeypatch, kinds):
    monkeypatch.setattr(E, "PACKED", 32)
    monkeypatch.setattr(E, "KINDS", kinds)
    rows = [(i, m, lab, int((i + k) % 3 > 0), int((i * k) % 5 < 2)) for i in range(100) if i != 40 for m in "ab" for k, lab in enumerate(("x", None, "z")) if (i + k) % 4]
    cells = spark.createDataFrame(rows, "idx long, model string, label string, g int, p int")
    got = E.bootstrap_sums(cells, 120, 20, 29, "model")  # some rows have no cells
    draws = E.bootstrap_draws(spark, 120, 20, 29)
    want = [(r[0], m, *r[1:]) for m in "ab" for r in E.bootstrap_cells(cells.filter(F.col("model") == m).drop("model"), draws).collect()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 100


def test_paired_bootstrap_scores_once(spark, tmp_path, monkeypatch):
    from codeweave.plans import experiments as X
    from codeweave.plans import q_sample_eval as Q
    docs = [(i, " ".join(["aa", "bb", "cc", "dd"][(i * k) % 4] for k in range(6)), ["en", "de"][i % 2], "src1") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    names, write = [], Q.written
    monkeypatch.setattr(Q, "written", lambda df, name="table", *a: names.append(name) or write(df, name, *a))
    monkeypatch.setattr(Q, "BOOT_B", 20)
    assert Q.e13(spark, str(tmp_path)).count() == 1 and names == ["predictions"]
