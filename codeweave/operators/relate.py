"""Joins and set operations (J01-J15) on long tables.

Dimension-like sides (codes, topics, labels, prompts) are broadcast only after a
size check or left to AQE; document-sized sides are
always shuffled/sort-merged."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_rows

MAX_DIM = 1_000_000


def assemble(records: DataFrame, transcripts: DataFrame, codes: DataFrame, key: str = "id") -> DataFrame:
    """Ids present in both records and transcripts; codes looked up (may be null)."""
    return records.join(transcripts, key).join(codes, key, "left")


def intersect_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids in both sets."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def difference_report(a: DataFrame, b: DataFrame, key: str, a_name: str = "a", b_name: str = "b") -> DataFrame:
    """Ids only in one side, tagged with the side that has them."""
    only_a = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("only_in", F.lit(a_name))
    only_b = b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("only_in", F.lit(b_name))
    return only_a.unionByName(only_b)


def resolve_links(entries: DataFrame, key: str, refs_col: str, rel: str) -> DataFrame:
    """Explode referenced codes and keep those that resolve to an entry
    (inner self-join); output edge table (key, rel, target)."""
    e = entries.select(F.col(key), F.explode_outer(refs_col).alias("target"))
    tgt = entries.select(F.col(key).alias("target"))
    return e.join(tgt, "target").select(key, F.lit(rel).alias("rel"), "target")


def linked_text(link: DataFrame, texts: DataFrame, code: str, topic: str, text: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Per code, the texts of its linked topics in topic order (long form:
    code, pos, text) and a report of links whose topic has no text."""
    j = link.join(texts, topic, "left")
    missing = j.filter(F.col(text).isNull()).select(code, topic)
    return j.filter(F.col(text).isNotNull()).select(code, topic, order, text), missing


def linked_only(topics: DataFrame, link: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """Topics linked to at least one code, and the dropped ones."""
    l = link.select(topic).distinct()
    return topics.join(l, topic, "left_semi"), topics.join(l, topic, "left_anti")


#: Most fine labels whose codes are held in a map expression; more go through a join.
MAP_LABELS = 1000


def fine_to_coarse(pred: DataFrame, mapping: DataFrame, fine: str = "label", coarse: str = "code",
                   drop_code: str = "Z", map_labels: int = MAP_LABELS) -> DataFrame:
    """Predicted fine labels mapped many-to-many to coarse codes; ``drop_code``
    removed; duplicates collapsed.

    Rows are reduced to the different labels of each document before codes fan out, and with at most
    ``map_labels`` labels (counted) the codes of a document are united within its row, so the
    fan-out itself is never shuffled. A larger mapping is joined after the same reduction."""
    cols = [c for c in pred.columns if c != fine]
    per = mapping.filter(F.col(coarse) != drop_code).groupBy(F.col(fine).alias("_label")).agg(F.collect_set(coarse).alias("_codes"))
    rows = per.limit(map_labels + 1).collect()
    if not rows or len(rows) > map_labels:
        one = pred.select(*cols, F.col(fine).alias("_label")).distinct().join(per, "_label")
        return one.select(*cols, F.explode("_codes").alias(fine)).distinct()
    known = pred.filter(F.col(fine).isNotNull()).groupBy(*cols).agg(F.collect_set(fine).alias("_labels"))
    table = F.map_from_arrays(F.array(*[F.lit(r["_label"]) for r in rows]), F.array(*[F.array(*[F.lit(c) for c in sorted(r["_codes"])]) for r in rows]))
    codes = F.filter(F.transform("_labels", lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull())
    return known.select(*cols, F.explode(F.array_distinct(F.flatten(codes))).alias(fine))


def label_overlap(link: DataFrame, code: str, topic: str) -> DataFrame:
    """Pairs of codes sharing at least one topic (including self pairs).
    Pairs are built per topic, so the output is bounded by sum(codes_per_topic^2)
    over a dimension table (codes x topics), never by documents."""
    a = link.select(F.col(code).alias("code1"), topic)
    b = link.select(F.col(code).alias("code2"), topic)
    return a.join(b, topic).select("code1", "code2").distinct()


def with_prompts(chunks: DataFrame, labels: DataFrame, template: str = "This is a problem of {}.",
                 max_labels: int = 100_000) -> DataFrame:
    """Each chunk paired with each label's prompt. The label set is a
    bounded dimension (checked), expanded per row from an array literal."""
    rows = bounded_rows(labels.select("label", "name").distinct().orderBy("label"), max_labels, "labels")
    arr = F.array(*[F.struct(F.lit(r["label"]).alias("label"),
                             F.lit(template.replace("{}", str(r["name"]))).alias("prompt")) for r in rows])
    return chunks.select("*", F.inline(arr))


def label_ids(labels: DataFrame, label: str = "label") -> DataFrame:
    """Dense ids 0..C-1 over the sorted label dimension."""
    d = labels.select(label).distinct()
    return d.select(label, (F.dense_rank().over(
        __import__("pyspark.sql.window", fromlist=["Window"]).Window.orderBy(label)) - 1).alias("label_id"))


def lookup_with_fallback(keys: DataFrame, lookup: DataFrame, key: str, value_cols: list) -> DataFrame:
    """Exact key lookup, else with leading zeros stripped."""
    a = lookup.select(F.col(key).alias("_k1"), *[F.col(c).alias("_a_" + c) for c in value_cols])
    b = lookup.select(F.col(key).alias("_k2"), *[F.col(c).alias("_b_" + c) for c in value_cols])
    j = (keys.join(a, keys[key] == a["_k1"], "left")
         .join(b, F.regexp_replace(keys[key], "^0+", "") == b["_k2"], "left"))  # noqa
    return j.select(*keys.columns, *[F.coalesce("_a_" + c, "_b_" + c).alias(c) for c in value_cols])


def fetch_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows for a list of ids (semi-join; the id list is size-checked before
    it is broadcast)."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def description_switch(a: DataFrame, b: DataFrame, mode: str) -> DataFrame:
    """Description bags from vocabulary A, B or both (A and B concatenated =
    their bags summed, label by label, full outer)."""
    if mode == "a":
        return a
    if mode == "b":
        return b
    return (a.withColumnRenamed("tf", "ta").join(b.withColumnRenamed("tf", "tb"), ["label", "term"], "full_outer")
            .select("label", "term", (F.coalesce("ta", F.lit(0)) + F.coalesce("tb", F.lit(0))).alias("tf")))


def truth_vs_pred(gold: DataFrame, pred: DataFrame, label: str) -> DataFrame:
    """For documents whose gold has ``label``: their gold and predicted label lists."""
    ids = gold.filter(F.col("label") == label).select("id")
    g = gold.join(ids, "id", "left_semi").groupBy("id").agg(F.concat_ws(",", F.sort_array(F.collect_list("label"))).alias("gold"))
    p = pred.join(ids, "id", "left_semi").groupBy("id").agg(F.concat_ws(",", F.sort_array(F.collect_list("label"))).alias("pred"))
    return g.join(p, "id", "left").na.fill("", ["pred"])


def granularity_labels(docs: DataFrame, granularity: str, coarse_col: str, fine_col: str) -> DataFrame:
    """The label column for the coarse (codes) or fine (topics) granularity."""
    col = coarse_col if granularity == "coarse" else fine_col
    return docs.select(F.col(col).alias("label"))


def inspect_document(one: DataFrame, gold: DataFrame, pred: DataFrame, doc_w: DataFrame, class_w: DataFrame) -> DataFrame:
    """One document's gold labels, predicted labels and cosine similarity to
    every class vector, as one row."""
    g = gold.join(one, "id", "left_semi").groupBy("id").agg(F.concat_ws(",", F.sort_array(F.collect_list("label"))).alias("gold"))
    p = pred.join(one, "id", "left_semi").groupBy("id").agg(F.concat_ws(",", F.sort_array(F.collect_list("label"))).alias("pred"))
    c = class_w.select(F.col("id").alias("label"), "term", F.col("w").alias("cw"))
    cos = (doc_w.join(one, "id", "left_semi").join(c, "term").groupBy("id", "label")
           .agg(F.sum(F.col("w") * F.col("cw")).alias("cosine")))
    sim = cos.groupBy("id").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("label", "cosine"))),
                                                             lambda e: F.concat(e["label"], F.lit("="),
                                                                                F.round(e["cosine"], 4).cast("string")))).alias("similarity"))
    return one.join(g, "id", "left").join(p, "id", "left").join(sim, "id", "left").na.fill("", ["pred"])
