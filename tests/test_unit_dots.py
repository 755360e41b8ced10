"""Products of unit vectors summed before the shuffle, against rows scaled first."""
import pytest
from pyspark.sql import functions as F

from codeweave.operators import classify as M
from codeweave.operators import vectorize as V

# id 1 has its rows twice, id 4 shares no term with class c, null ids are one vector
ROWS = [(1, "x", 1.0), (1, "y", 2.0), (1, "x", 1.0), (1, "y", 2.0), (2, "x", 3.0), (4, "y", 0.5), (None, "x", 1.0), (None, "z", 2.0)]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, "id long, term string, w double")


@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame([("a", "x", 0.6), ("a", "y", 0.8), ("c", "x", 1.0)], "id string, term string, w double")


def _rows(df):
    return sorted(((str(r[0]), r[1]) + tuple(round(v, 9) for v in r[2:]) for r in df.collect()))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cosine_of_raw_rows(raw, classes, monkeypatch):
    got = V.cosine_to_classes(raw, classes, raw=True)
    want = _rows(V.cosine_to_classes(V.unit(raw), classes))
    assert _rows(got) == want and len(want) == 7
    assert "Window" not in _plan(got)
    monkeypatch.setattr(V, "SIDE_BY_SIDE", 1)
    assert _rows(V.cosine_to_classes(raw, classes, raw=True)) == want


def test_scores_of_raw_rows(spark, raw, monkeypatch):
    base = spark.createDataFrame([("a", -2.0), ("c", -3.0)], "label string, base double")
    model = spark.createDataFrame([("a", "x", 0.5), ("a", "z", 0.1), ("c", "y", 1.5)], "label string, term string, delta double")
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "id long")
    got = M.score_linear_sparse(ids, raw, base, model, raw=True)
    want = _rows(M.score_linear_sparse(ids, V.unit(raw), base, model))
    assert _rows(got) == want and len(want) == 10
    assert "Window" not in _plan(got)
    monkeypatch.setattr(M, "SIDE_BY_SIDE", 1)
    assert _rows(M.score_linear_sparse(ids, raw, base, model, raw=True)) == want


def test_distant_setup_stores_no_term_rows(spark):
    from codeweave.plans import experiments as X
    s = X.distant_setup(spark, "/root/testdata/sf0.001")
    assert not s.counts.is_cached and "InMemoryRelation" not in _plan(s.counts.filter(F.length("term") > 0))
    both = s.test_x.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n"))
    assert both.filter("abs(n - 1) > 1e-9").count() == 0
