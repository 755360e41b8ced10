"""Registered queries: joins and set operations J01-J15 on the driver's tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relate as J
from ..sources.tables import table
from .registry import query

DROP_BRAND = "Brand#55"


@query("j01_assemble", """WITH r AS (SELECT o_orderkey AS id, o_custkey FROM orders),
t AS (SELECT l_orderkey AS id, CAST(count(*) AS BIGINT) AS n_lines FROM lineitem GROUP BY l_orderkey),
c AS (SELECT l_orderkey AS id, CAST(count(*) AS BIGINT) AS n_returned FROM lineitem WHERE l_returnflag = 'R'
      GROUP BY l_orderkey)
SELECT id, o_custkey, n_lines, n_returned FROM r JOIN t USING (id) LEFT JOIN c USING (id)""")
def j01(spark, d):
    li = table(spark, d, "lineitem")
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    t = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n_lines"))
    c = (li.filter(F.col("l_returnflag") == "R").groupBy(F.col("l_orderkey").alias("id"))
         .agg(F.count(F.lit(1)).alias("n_returned")))
    return J.assemble(r, t, c)


@query("j02_intersect_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def j02(spark, d):
    return J.intersect_ids(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("j03_difference_report", """SELECT doc_id, 'documents' AS only_in FROM
  (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'labels' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def j03(spark, d):
    return J.difference_report(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id",
                               "documents", "labels")


@query("j04_resolve_links", """WITH e AS (SELECT CAST(p_partkey AS VARCHAR) AS code,
  [CAST(p_size AS VARCHAR), CAST(p_partkey + 5000 AS VARCHAR)] AS refs FROM part)
SELECT x.code, 'consider' AS rel, x.target FROM (SELECT code, unnest(refs) AS target FROM e) x
JOIN (SELECT code AS target FROM e) t USING (target)""")
def j04(spark, d):
    p = table(spark, d, "part")
    e = p.select(F.col("p_partkey").cast("string").alias("code"),
                 F.array(F.col("p_size").cast("string"), (F.col("p_partkey") + 5000).cast("string")).alias("refs"))
    return J.resolve_links(e, "code", "refs", "consider")


_J05_SQL = """WITH link AS (SELECT r_name AS code, n_name AS topic FROM nation JOIN region ON n_regionkey = r_regionkey),
texts AS (SELECT n_name AS topic, lower(n_name) AS text FROM nation
          WHERE n_nationkey IN (SELECT s_nationkey FROM supplier))"""


@query("j05_linked_text", _J05_SQL + """
SELECT code, topic, text FROM link JOIN texts USING (topic)""")
def j05(spark, d):
    link, texts = _j05_inputs(spark, d)
    found, _ = J.linked_text(link, texts, "code", "topic", "text", "topic")
    return found.select("code", "topic", "text")


@query("j05_missing_topics", _J05_SQL + """
SELECT code, topic FROM link WHERE topic NOT IN (SELECT topic FROM texts)""")
def j05m(spark, d):
    link, texts = _j05_inputs(spark, d)
    return J.linked_text(link, texts, "code", "topic", "text", "topic")[1]


def _j05_inputs(spark, d):
    n, r, s = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "supplier")
    link = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("code"), F.col("n_name").alias("topic"))
    texts = (n.join(s, n.n_nationkey == s.s_nationkey, "left_semi")
             .select(F.col("n_name").alias("topic"), F.lower("n_name").alias("text")))
    return link, texts


_J06_LINK = """link AS (SELECT DISTINCT l_returnflag AS code, p_type AS topic FROM lineitem
  JOIN part ON l_partkey = p_partkey WHERE l_discount >= 0.1)"""


@query("j06_linked_topics", f"""WITH {_J06_LINK}, topics AS (SELECT DISTINCT p_type AS topic FROM part)
SELECT topic, topic IN (SELECT topic FROM link) AS linked FROM topics""")
def j06(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    link = (li.filter(F.col("l_discount") >= 0.1).join(p, li.l_partkey == p.p_partkey)
            .select(F.col("l_returnflag").alias("code"), F.col("p_type").alias("topic")).distinct())
    topics = p.select(F.col("p_type").alias("topic")).distinct()
    kept, dropped = J.linked_only(topics, link, "topic")
    return kept.withColumn("linked", F.lit(True)).unionByName(dropped.withColumn("linked", F.lit(False)))


@query("j07_fine_to_coarse", f"""WITH pred AS (SELECT l_orderkey AS id, p_type AS label FROM lineitem
  JOIN part ON l_partkey = p_partkey),
m AS (SELECT DISTINCT p_type AS label, p_brand AS code FROM part)
SELECT DISTINCT id, code AS label FROM pred JOIN m USING (label) WHERE code <> '{DROP_BRAND}'""")
def j07(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    pred = (li.join(p, li.l_partkey == p.p_partkey)
            .select(F.col("l_orderkey").alias("id"), F.col("p_type").alias("label")))
    m = p.select(F.col("p_type").alias("label"), F.col("p_brand").alias("code")).distinct()
    return J.fine_to_coarse(pred, m, "label", "code", DROP_BRAND)


@query("j09_label_overlap", """WITH link AS (SELECT DISTINCT p_brand AS code, p_type AS topic FROM part)
SELECT DISTINCT a.code AS code1, b.code AS code2 FROM link a JOIN link b USING (topic)""")
def j09(spark, d):
    link = table(spark, d, "part").select(F.col("p_brand").alias("code"), F.col("p_type").alias("topic")).distinct()
    return J.label_overlap(link, "code", "topic")


@query("j10_chunk_label_prompts", """SELECT item_id, label, 'This is a problem of ' || label || '.' AS prompt
FROM benchmark, (SELECT DISTINCT lang AS label FROM documents)""")
def j10(spark, d):
    labels = table(spark, d, "documents").select(F.col("lang").alias("label"), F.col("lang").alias("name"))
    return J.with_prompts(table(spark, d, "benchmark").select("item_id"), labels)


@query("j11_label_ids", """SELECT source AS label, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS label_id
FROM (SELECT DISTINCT source FROM documents)""")
def j11(spark, d):
    l = table(spark, d, "documents").select(F.col("source").alias("label"))
    return J.label_ids(l).select("label", F.col("label_id").cast("bigint"))


@query("j15_fetch_ids", """SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def j15(spark, d):
    ids = (table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING")
           .select(F.col("c_custkey").alias("o_custkey")))
    return J.fetch_ids(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")
