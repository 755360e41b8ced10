"""Ranked lexical search of many queries at once, sharing what the queries have in common.

Scores are sums over a query's terms of an integer saturated term weight, so the sum over a set of
terms that several queries share can be taken once and used by all of them.

1. Queries (``items``) become rows (item, node), first one node per term and its repeats.
   ``mine`` finds shared term sets in Spark: nodes of an item are ordered by how many items use
   them, neighbours that at least two items have side by side become one node, and so
   on with the new nodes. The result is a DAG: leaves (term, repeats), shared nodes (two others),
   and items (a few nodes each). Only neighbours are paired, so a round is linear in its rows.
2. ``postings`` reads the documents once: number of terms, and the frequencies of the terms that
   the items use. Document frequencies and totals are aggregated from it in Spark.
3. ``search`` evaluates the DAG over blocks of documents: each shared node is one accumulator over
   the block, computed once, then combined into its users, and freed after the last of them.
   A task keeps the best ``k`` of each item and sends only these; a window ranks them.

Postings are never shuffled: work grows with the documents and the nodes, and a term or text that a
third of all documents hold costs its share in every task. Items are dealt to blocks of about
``BLOCK_TERMS`` terms in all (at least one item), one pass over the documents each, which bounds the
DAG that is broadcast.

Defined cases: null text has no term; items without terms, or whose terms no document holds, have no
rows; repeated rows of items (id and text) count once, of documents each; equal scores
go by doc_id, null last; empty tables give an empty result; other columns are ignored."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, own_columns, share, stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same rule for bytes: other ASCII characters become blanks, A-Z small letters, the rest stays.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
#: Terms of the items of one block, documents of one accumulator, rounds of pairing.
BLOCK_TERMS, DOCS, ROUNDS = 1 << 18, 2048, 12


# -- shared term sets ------------------------------------------------------------------------

def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times): terms of the distinct rows (item_id, text); ``item`` is a digest of both."""
    d = own_columns(items, item_id=("item_id", "long"), text=("text", "string")).distinct()
    item = F.md5(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), F.col("text")).cast("binary"))
    d = d.select(item.alias("item"), "item_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term"))
    return d.groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def _pair(a, b):
    return F.md5(F.concat(a, F.lit(":"), b).cast("binary"))


def mine(uses: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[DataFrame]]:
    """Of uses (item, node): the same items in fewer nodes, and the shared nodes (node, a, b) by round."""
    shared, seq = [], uses
    in_order = Window.partitionBy("item").orderBy("pos")
    for _ in range(rounds):
        often = seq.groupBy("node").agg(F.count(F.lit(1)).alias("users"))
        p = seq.join(often, "node").withColumn("pos", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("users"), "node")))
        p = p.withColumn("nxt", F.lead("node").over(in_order))
        k = p.filter("nxt is not null").groupBy("node", "nxt").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
        p = p.join(k, ["node", "nxt"], "left").withColumn("weight", F.when(F.col("k").isNotNull(), F.struct("k", _pair(F.col("node"), F.col("nxt")).alias("id"))))
        # of overlapping pairs the one that more items use, so that none shares a node with a taken one
        p = p.withColumn("before", F.lag("weight").over(in_order)).withColumn("after", F.lead("weight").over(in_order))
        take = F.col("weight").isNotNull() & (F.col("before").isNull() | (F.col("weight") > F.col("before"))) & \
            (F.col("after").isNull() | (F.col("weight") > F.col("after")))
        p = p.withColumn("take", take).withColumn("second", F.coalesce(F.lag("take").over(in_order), F.lit(False)))
        new = stage(p.filter(~F.col("second")).select(
            "item", F.when(F.col("take"), F.col("weight.id")).otherwise(F.col("node")).alias("node"),
            F.when(F.col("take"), F.col("node")).alias("a"), F.when(F.col("take"), F.col("nxt")).alias("b")), "shared")
        pairs = new.filter("a is not null")
        if not pairs.head(1):
            break
        shared.append(pairs.select("node", "a", "b").distinct())
        seq = new.select("item", "node")
    return seq, shared


class Dag:
    """Evaluation order of one block of items. Nodes are numbered: leaves first (term number, times),
    then shared nodes (two earlier ones each); ``items`` are (item_id, nodes)."""

    def __init__(self, terms, leaves, shared, items):
        self.terms, self.leaves, self.shared, self.items = terms, leaves, shared, items
        self.weights = None
        left = [0] * (len(leaves) + len(shared))
        for pair in shared:
            for x in pair:
                left[x] += 1
        for _, nodes in items:
            for x in nodes:
                left[x] += 1
        self.users = left

    def scores(self, rows, values, count):
        """For each item (its place, accumulator over ``count`` documents). ``rows[t]`` and ``values[t]`` are the
        documents that hold term t and what it adds to them."""
        held, left, n = {}, list(self.users), len(self.leaves)

        def add(acc, x):
            if x < n:
                t, times = self.leaves[x]
                if len(rows[t]):
                    acc[rows[t]] += values[t] * times
                return
            acc += held[x]
            left[x] -= 1
            if not left[x]:
                del held[x]
        for i, (a, b) in enumerate(self.shared):
            acc = np.zeros(count, dtype=np.int64)
            add(acc, a)
            add(acc, b)
            held[n + i] = acc
        for i, (_, nodes) in enumerate(self.items):
            acc = np.zeros(count, dtype=np.int64)
            for x in nodes:
                add(acc, x)
            yield i, acc


def build_dag(terms: DataFrame, rounds: int = ROUNDS) -> Dag:
    """The DAG of a block of items (item, item_id, term, times); its size is bounded by the block."""
    leaf = F.md5(F.concat_ws(":", F.col("times").cast("string"), F.col("term")).cast("binary"))
    uses = stage(terms.select("item", "item_id", "term", "times", leaf.alias("node")), "uses")
    seq, shared = mine(uses.select("item", "node"), rounds)
    number, words, leaves, pairs = {}, {}, [], []
    for r in uses.select("node", "term", "times").distinct().collect():
        number[r["node"]] = len(leaves)
        leaves.append((words.setdefault(r["term"].encode(), len(words)), r["times"]))
    for level in shared:
        for r in level.collect():
            number[r["node"]] = len(leaves) + len(pairs)
            pairs.append((number[r["a"]], number[r["b"]]))
    items: dict = {}
    for r in seq.join(uses.select("item", "item_id").distinct(), "item").collect():
        items.setdefault(r["item"], (r["item_id"], []))[1].append(number[r["node"]])
    return Dag(words, leaves, pairs, list(items.values()))


# -- documents -------------------------------------------------------------------------------

def postings(docs: DataFrame, terms: dict) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with terms: number of their terms with repeats, and
    numbers and frequencies of those in ``terms``."""
    held = share(docs.sparkSession, terms)

    def run(batches):
        from collections import Counter

        import pyarrow as pa
        number = held.value
        for b in batches:
            ids, sizes, places, tfs, ends = [], [], [], [], [0]
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                words = t.encode().translate(_FOLD).split()
                if not words:
                    continue
                ids.append(d)
                sizes.append(len(words))
                c = Counter(words)
                for w in c.keys() & number.keys():
                    places.append(number[w])
                    tfs.append(c[w])
                ends.append(len(places))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(places, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))], names=["doc_id", "n", "terms", "tfs"])
    d = own_columns(docs, doc_id=("doc_id", "long"), text=("text", "string"))
    return d.filter("text is not null").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _best(scores, ids, nulls, k):
    """Places of the best k: highest score, then smallest id, null last."""
    return np.lexsort((ids, nulls, -scores))[:k]


def evaluate(posted: DataFrame, dag: Dag, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): every task's best ``k`` documents of each item."""
    held = share(posted.sparkSession, dag)

    def run(batches):
        import pyarrow as pa
        dag = held.value
        w = np.asarray(dag.weights, dtype=np.int64)
        none = np.zeros(0, np.int64)
        best = [(none, none, none)] * len(dag.items)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                b = batch.slice(at, DOCS)
                lists, tfs = b.column("terms"), b.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                t = lists.flatten().to_numpy(zero_copy_only=False)
                count = b.num_rows
                row = np.repeat(np.arange(count), np.diff(lists.offsets.to_numpy()))
                m = 100 - 75 + 75 * b.column("n").to_numpy() * n_docs // n_terms
                x = w[t] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[row]))
                by = np.argsort(t, kind="stable")
                cuts = np.searchsorted(t[by], np.arange(len(w) + 1))
                row, x = row[by], x[by]
                rows = [row[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
                values = [x[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
                null = b.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = b.column("doc_id").fill_null(0).to_numpy()
                for i, acc in dag.scores(rows, values, count):
                    s, d, z = best[i]
                    new = np.flatnonzero(acc >= (s[-1] if len(s) == k else 1))
                    if len(new):
                        s, d, z = np.concatenate((s, acc[new])), np.concatenate((d, ids[new])), np.concatenate((z, null[new]))
                        o = _best(s, d, z, k)
                        best[i] = s[o], d[o], z[o]
        for i, (s, d, z) in enumerate(best):
            if len(s):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(s), i, np.int32)), pa.array([dag.items[i][0]] * len(s), pa.int64()),
                    pa.array(d, mask=z.astype(bool)), pa.array(s)], names=["item", "item_id", "doc_id", "score"])
    return posted.mapInArrow(run, "item int, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS, rounds: int = ROUNDS) -> DataFrame:
    """(item_id, rank, doc_id, score): for every item the ``k`` documents with the highest scores above 0."""
    spark = docs.sparkSession
    terms = stage(item_terms(items), "item-terms")
    blocks = max(1, -(-terms.count() // block_terms))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        part = terms.filter(F.pmod(F.crc32(F.col("item").cast("binary")), F.lit(blocks)) == block)
        dag = build_dag(part, rounds)
        posted = stage(postings(docs, dag.terms), "postings")
        n_docs, n_terms = posted.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = dict(posted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row per term of the block
        dag.weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(dag.terms))]
        best = evaluate(posted, dag, n_docs, n_terms or 1, k)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        out = out.unionByName(best.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    return out


def op12_ranked_search(spark, sf_dir):
    return search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES = {"op12_ranked_search": op12_ranked_search}
ORACLES = {"op12_ranked_search": rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms
           FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, len(terms) AS n, terms FROM t WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, sum(n) AS total FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
i AS (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM i) GROUP BY q, term),
m AS (SELECT r, doc_id, 100 - 75 + CAST((75 * n * docs) // total AS BIGINT) AS m FROM d, s),
a AS (SELECT q.q, p.r, sum(q.times * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN m ON m.r = p.r GROUP BY q.q, p.r),
o AS (SELECT i.item_id, row_number() OVER (PARTITION BY a.q ORDER BY score DESC, m.doc_id NULLS LAST) AS rank, m.doc_id, score
      FROM a JOIN m ON m.r = a.r JOIN i ON i.q = a.q WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 10"""}
