"""Vectorisation (V01-V07) in long form: (id, term, w).

Physical shape (per document one row in, many rows out):
  * tokens are cut in the row by Spark and counted document by document in
    Arrow batches, so V01/V02 need no shuffle at all; scoring emits rows for
    vocabulary terms only;
  * the fitted vocabulary is capped (``max_features``) so it is a proven-small
    broadcast side;
  * the L2 norm is one window over ``id`` -- the only shuffle of transform; the
    result stays hash-partitioned by ``id`` for the scoring steps after it.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import spread
from ..functions.text import UNICODE_TOKENS, remove_words, tokens


def word_tokens(text, stop: list | None = None, pattern: str = UNICODE_TOKENS) -> Column:
    """Lower-cased regex tokens with stopwords removed (before n-grams)."""
    return remove_words(tokens(text, pattern), stop or [])


#: Terms that a task counts before it hands their rows on.
COUNTED_ROWS = 100_000


def _counted(t: DataFrame, keep: list, stops: dict, ngram: int, only: list | None) -> DataFrame:
    """(key, id, term, tf, keep...) of rows (id, keep..., _t) with a document's tokens joined by spaces: per key of ``stops``
    its words are left out, adjacent pairs are added and terms are counted, document by document; no shuffle.
    ``only``: the terms (a vocabulary) that get rows."""
    from collections import Counter
    stops = {key: frozenset(stop or ()) for key, stop in stops.items()}
    singles = None if only is None else frozenset(x for x in only if " " not in x)
    pairs = None if only is None else frozenset(tuple(x.split(" ")) for x in only if " " in x)
    cols = ["id", *keep]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            at, keys, terms, tfs = [], [], [], []

            def out():
                rows = pa.array(np.repeat(np.array([i for i, _ in at], np.int64), [n for _, n in at]))
                named = dict(zip(cols, (b.column(c).take(rows) for c in cols)))
                named |= {"key": pa.array(keys, pa.string()), "term": pa.array(terms, pa.string()), "tf": pa.array(tfs, pa.int64())}
                return pa.RecordBatch.from_arrays([named[c] for c in ("key", "id", "term", "tf", *keep)], names=["key", "id", "term", "tf", *keep])
            for i, text in enumerate(b.column("_t")):
                toks = (text.as_py() or "").split()
                for key, stop in stops.items():
                    words = [x for x in toks if x not in stop] if stop else toks
                    n = Counter(words if singles is None else [x for x in words if x in singles])
                    if ngram >= 2:
                        both = zip(words, words[1:])
                        n.update(map(" ".join, both if pairs is None else [x for x in both if x in pairs]))
                    if n:
                        at.append((i, len(n)))
                        keys.extend([key] * len(n))
                        terms.extend(n)
                        tfs.extend(n.values())
                if len(terms) >= COUNTED_ROWS:
                    yield out()
                    at, keys, terms, tfs = [], [], [], []
            yield out()
    kind = {f.name: f.dataType for f in t.schema}
    schema = StructType([StructField("key", StringType()), StructField("id", kind["id"]), StructField("term", StringType()), StructField("tf", LongType()),
                         *[StructField(c, kind[c]) for c in keep]])
    return t.mapInArrow(run, schema)


def _joined_tokens(df: DataFrame, id_col: str, text_col: str, keep: list, spread_input: bool, pattern: str) -> DataFrame:
    t = df.select(F.col(id_col).alias("id"), F.col(text_col), *keep)
    if spread_input:
        t = spread(t, "id")
    return t.select("id", *keep, F.array_join(tokens(F.col(text_col), pattern), " ").alias("_t"))


def term_counts(df: DataFrame, id_col: str, text_col: str, stop: list | None = None,
                ngram: int = 2, pattern: str = UNICODE_TOKENS, keep: list | None = None,
                spread_input: bool = True, only: list | None = None) -> DataFrame:
    """(id, term, tf[, keep...]) for every document; no shuffle (besides the
    optional spreading of an under-split input). ``pattern`` matches no white space;
    ``only``: count these terms (a bounded vocabulary) and no others."""
    keep = list(keep or [])
    t = _joined_tokens(df, id_col, text_col, keep, spread_input, pattern)
    return _counted(t, keep, {"": stop}, ngram, only).select("id", *keep, "term", "tf")


def term_counts_by(df: DataFrame, id_col: str, text_col: str, stops: dict[str, list], keep: list | None = None,
                   spread_input: bool = True, count=None) -> DataFrame:
    """(key, id, term, tf[, keep...]) for every stopword setting (key -> words): the text is read and
    cut into tokens once, and each setting removes its words and counts within the row. ``count`` makes something else of
    the rows (id[, keep...], _t), a text's tokens joined by blanks: see :mod:`.termcount`."""
    keep = list(keep or [])
    t = _joined_tokens(df, id_col, text_col, keep, spread_input, UNICODE_TOKENS)
    return count(t) if count else _counted(t, keep, stops, 2, None)


def fit_vocabulary(counts: DataFrame, max_features: int = 5000, n_docs: int | None = None) -> DataFrame:
    """V03+V04: top ``max_features`` terms by total corpus count (ties by term),
    smoothed idf ``ln((1+n)/(1+df)) + 1`` with n = documents in the fit corpus, those
    without a term included (``n_docs``; counted from ``counts`` only if not given)."""
    if n_docs is None:
        n_docs = counts.select("id").distinct().count()
    stats = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    top = stats.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    return top.select(
        "term", "total", "df",
        (F.log((F.lit(1.0 + n_docs)) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def weighted(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, term, w): tf*idf on the fitted vocabulary, not yet of unit length; no shuffle."""
    v = F.broadcast(vocab.select("term", "idf"))  # bounded by max_features
    return counts.join(v, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))


def unit(raw: DataFrame) -> DataFrame:
    """Rows (id, term, w) scaled to unit length per id."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / norm).alias("w"))


def tfidf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """tf*idf on the fitted vocabulary, L2-normalised per id; unseen terms
    dropped; a document with no vocabulary term has no rows (zero vector)."""
    return unit(weighted(counts, vocab))


#: Most classes whose products are summed side by side.
SIDE_BY_SIDE = 64


def unit_dots(raw: DataFrame, model: DataFrame, labels: list, value: str) -> DataFrame:
    """(id, wsum, dots): of the unit vector of each id of ``raw`` (id, term, w) the sum of its weights and its products
    with the vectors ``model`` (label, term, value), in the order of ``labels`` (null: no term shared).

    All are sums over the rows of an id, and so is the squared length they are divided by in the end: tasks sum
    before the shuffle, which has one row per id and task instead of one per (id, term)."""
    of = [F.sum(F.when(F.col("label") == label, F.col(value))).alias(f"_d{i}") for i, label in enumerate(labels)]
    per_term = F.broadcast(model.groupBy("term").agg(*of))  # bounded by max_features
    w = F.col("w")
    sums = raw.join(per_term, "term", "left").groupBy("id").agg(
        F.sqrt(F.sum(w * w)).alias("_n"), F.sum("w").alias("_w"), *[F.sum(w * F.col(f"_d{i}")).alias(f"_s{i}") for i in range(len(labels))])
    dots = F.array(*[F.col(f"_s{i}") / F.col("_n") for i in range(len(labels))]).cast("array<double>")
    return sums.select("id", (F.col("_w") / F.col("_n")).alias("wsum"), dots.alias("dots"))


def cosine_to_classes(doc_w: DataFrame, class_w: DataFrame, raw: bool = False) -> DataFrame:
    """Cosine similarity of each document with each class vector (both unit
    vectors in long form): sum of products over shared terms. ``raw``: ``doc_w`` is not of unit length yet."""
    c = class_w.select(F.col("id").alias("label"), "term", F.col("w").alias("cw"))
    if raw:
        labels = [r["label"] for r in c.select("label").distinct().orderBy("label").limit(SIDE_BY_SIDE + 1).collect()]
        if len(labels) <= SIDE_BY_SIDE:
            d = unit_dots(doc_w, c, labels, "cw")
            z = F.arrays_zip(F.array(*[F.lit(x) for x in labels]).alias("label"), F.col("dots").alias("cosine"))
            return d.select("id", F.inline(z)).filter(F.col("cosine").isNotNull())
        doc_w = unit(doc_w)
    return (doc_w.join(c, "term")
            .groupBy("id", "label").agg(F.sum(F.col("w") * F.col("cw")).alias("cosine")))


def density(weights: DataFrame, n_docs: Column | int, vocab_size: Column | int) -> DataFrame:
    """Share of non-zero cells of the (docs x vocabulary) matrix; its cells are more than an int holds."""
    cells = F.lit(n_docs).cast("bigint") * F.lit(vocab_size).cast("bigint")
    return weights.agg((F.count(F.lit(1)) / cells).alias("density"))
