"""Aggregations, sorts, top-k and windows (A01-A15) on long tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_rows


def category_term_bags(counts: DataFrame, member: DataFrame, cat: str = "cat",
                       drop_extremes: bool = True) -> DataFrame:
    """A01 (long form): a category's text = the union of its members' term bags,
    i.e. the group-concat tokenised without ever building one giant string.
    The first and last category by name are dropped (the reference's sorted
    slice). Output (cat, term, tf)."""
    j = counts.join(member.select("id", cat), "id")
    if drop_extremes:
        ext = bounded_rows(member.agg(F.min(cat).alias("lo"), F.max(cat).alias("hi")), 1)[0]
        j = j.filter((F.col(cat) != ext["lo"]) & (F.col(cat) != ext["hi"]))
    return j.groupBy(cat, "term").agg(F.sum("tf").alias("tf"))


def label_frequency(doc_labels: DataFrame) -> DataFrame:
    """Documents per label (distinct (id,label) pairs)."""
    return doc_labels.select("id", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def labels_per_doc_histogram(doc_labels: DataFrame) -> DataFrame:
    """How many documents carry k labels."""
    per = doc_labels.select("id", "label").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n_labels"))
    return per.groupBy("n_labels").agg(F.count(F.lit(1)).alias("n_docs"))


def one_hot(doc_labels: DataFrame, classes: list) -> DataFrame:
    """Per id the 0/1 vector over the sorted class list (bounded dimension)."""
    per = doc_labels.groupBy("id").agg(F.collect_set("label").alias("_ls"))
    arr = F.array(*[F.lit(c) for c in classes])
    return per.select("id", F.transform(arr, lambda c: F.array_contains("_ls", c).cast("int")).alias("onehot"))


def inverse_one_hot(flags: DataFrame) -> DataFrame:
    """(id, label, flag) -> (id, sorted label list of set flags)."""
    return flags.groupBy("id").agg(
        F.sort_array(F.collect_list(F.when(F.col("flag") == 1, F.col("label")))).alias("labels"))


def flatten_codes(df: DataFrame, id_col: str, codes_col: str) -> DataFrame:
    """(id, code) pairs, skipping null and process ('-') codes."""
    e = df.select(F.col(id_col).alias("id"), F.explode(codes_col).alias("code"))
    return e.filter(F.col("code").isNotNull() & ~F.col("code").startswith("-"))


def common_terms(weights: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Terms whose summed weight over the corpus exceeds the threshold."""
    return weights.groupBy("term").agg(F.sum("w").alias("total_w")).filter(F.col("total_w") > threshold)


def top_terms_per_label(weights: DataFrame, doc_labels: DataFrame, k: int = 10) -> DataFrame:
    """Per label, the k terms with the highest summed weight (ties by term).
    The window runs over the (label, term) aggregate, bounded by labels x vocabulary."""
    s = weights.join(doc_labels, "id").groupBy("label", "term").agg(F.sum("w").alias("w"))
    rn = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("w"), F.asc("term")))
    return s.withColumn("rank", rn).filter(F.col("rank") <= k)


def merge_chunks(chunk_pred: DataFrame, doc_col: str = "doc_id", renormalise: bool = False) -> DataFrame:
    """A10: a document gets every label predicted on any chunk; its score is the
    max chunk score (``renormalise`` divides by the per-document score sum)."""
    m = chunk_pred.groupBy(doc_col, "label").agg(F.bool_or("pred").alias("pred"), F.max("score").alias("score"))
    if renormalise:
        m = m.withColumn("score", F.col("score") / F.sum("score").over(Window.partitionBy(doc_col)))
    return m


def supportive_chunks(chunk_scores: DataFrame, key_cols: list, k: int | None = None) -> DataFrame:
    """Each chunk's arg-max label (ties to the smaller label), grouped by
    that label and ranked by probability (descending)."""
    best = chunk_scores.groupBy(*key_cols).agg(
        F.min_by(F.struct("label", "score"), F.struct(-F.col("score"), F.col("label"))).alias("_b"))
    out = best.select(*key_cols, F.col("_b.label").alias("label"), F.col("_b.score").alias("score"))
    if k is not None:
        rn = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), *key_cols))
        out = out.withColumn("rank", rn).filter(F.col("rank") <= k)
    return out


def majority_class(doc_labels: DataFrame) -> DataFrame:
    """Most frequent label (ties to the smaller label) and its share of documents."""
    n_docs = doc_labels.select("id").distinct().count()
    f = label_frequency(doc_labels)
    return f.agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), F.col("label"))).alias("b")).select(
        F.col("b.label").alias("label"), (F.col("b.n") / F.lit(n_docs)).alias("share"))


def fold_mean_best(results: DataFrame, method: str = "method", setting: str = "setting",
                   metric: str = "f1") -> DataFrame:
    """Mean over folds per (method, setting), then the best setting per method."""
    m = results.groupBy(method, setting).agg(F.avg(metric).alias(metric))
    return m.groupBy(method).agg(
        F.min_by(F.struct(setting, metric), F.struct(-F.col(metric), F.col(setting))).alias("b")).select(
        method, F.col(f"b.{setting}").alias(setting), F.col(f"b.{metric}").alias(metric))


def overlapping_windows(units: DataFrame, id_col: str, pos_col: str, text_col: str, start: int,
                        before: int = 5, after: int = 5) -> DataFrame:
    """For every position i in [start, n): the units [max(i-5,0), min(i+5,n)).

    Built as an equi-aggregation, not a window: each unit is copied to the (at
    most before+after) window positions that contain it and grouped by
    (id, i) -- a near-unique key, so one huge document never lands in one task."""
    n = units.groupBy(id_col).agg((F.max(pos_col) + 1).alias("_n"))
    copies = units.select(id_col, pos_col, text_col,
                          F.explode(F.sequence(F.col(pos_col) - (after - 1), F.col(pos_col) + before)).alias("i"))
    c = copies.join(n, id_col).filter((F.col("i") >= start) & (F.col("i") < F.col("_n")))
    g = c.groupBy(id_col, "i").agg(F.sort_array(F.collect_list(F.struct(pos_col, text_col))).alias("_w"))
    return g.select(id_col, "i", F.concat_ws(" ", F.transform("_w", lambda e: e[text_col])).alias("text"),
                    F.size("_w").alias("n_units"))


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """First n rows by key (a top-k: TakeOrderedAndProject)."""
    return df.orderBy(key).limit(n)
