"""Property checks (hypothesis) on in-row operators: packing, term bags, softmax."""
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeweave.functions import text as T
from codeweave.operators import chunk as C
from codeweave.operators import vectorize as V

sizes = st.lists(st.integers(min_value=1, max_value=40), min_size=1, max_size=25)


@settings(max_examples=15, deadline=None)
@given(sizes=sizes, max_tokens=st.integers(min_value=5, max_value=60))
def test_packing_invariants(spark, sizes, max_tokens):
    units = [" ".join(["w%d" % i] * n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame([(1, units)], "id long, units array<string>")
    ch = [r for r in C.pack_units(df, ["id"], "units", max_tokens).orderBy("chunk_id").collect()]
    assert [r["chunk_id"] for r in ch] == list(range(len(ch)))
    assert sum(r["n_units"] for r in ch) == len(units)
    assert " ".join(r["text"].strip() for r in ch) == " ".join(units)
    for r in ch:  # a chunk is under the limit unless it is one over-long unit
        assert len(r["text"].split()) < max_tokens or r["n_units"] == 1


@settings(max_examples=15, deadline=None)
@given(words=st.lists(st.sampled_from(["aa", "bb", "cc", "dd", "the", "zz9"]), max_size=30))
def test_term_bag_counts(spark, words):
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    got = {r["term"]: r["tf"] for r in V.term_counts(df, "doc_id", "text", ["the"]).collect()}
    toks = [w for w in words if w != "the"]
    want = Counter(toks) + Counter(a + " " + b for a, b in zip(toks, toks[1:]))
    assert got == dict(want)


@settings(max_examples=15, deadline=None)
@given(xs=st.lists(st.floats(min_value=-50, max_value=50), min_size=1, max_size=20))
def test_softmax_sums_to_one(spark, xs):
    p = spark.range(1).select(T.softmax(F.array(*[F.lit(x) for x in xs])).alias("p")).first()["p"]
    assert abs(sum(p) - 1.0) < 1e-9 and all(v >= 0 for v in p)
