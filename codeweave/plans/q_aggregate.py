"""Registered queries: aggregations A01-A15 and chunking C01-C04."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stopwords import stopword_list
from ..operators import aggregate as A
from ..operators import chunk as C
from ..operators import vectorize as V
from ..operators.sample import grouped_rank
from ..functions.hashing import stable_hash
from ..session import bounded_rows
from ..sources.tables import table
from . import experiments as X
from .q_core import DISTANT_SQL, STOP
from .q_text import t06_expr
from .registry import query, rounded
from .sqlkit import sql_hash, terms_cte, tfidf_ctes, weights_cte

TURN_SQL = f"""{DISTANT_SQL},
{terms_cte('conversations', "conv_id || ':' || turn", 'text', STOP, 'qc')},
{weights_cte('qw', 'qc', 'v_vocab')},
qids AS (SELECT conv_id || ':' || turn AS id FROM conversations),
{__import__('codeweave.plans.sqlkit', fromlist=['nb_score_ctes']).nb_score_ctes('qids', 'qw', 'nb', 'qs')},
turns AS (SELECT CAST(split_part(id, ':', 1) AS BIGINT) AS conv_id, CAST(split_part(id, ':', 2) AS BIGINT) AS turn, label, score > 0.1 AS pred, score
          FROM qs)"""


@query("a01_category_term_bags", f"""WITH {terms_cte('part', 'p_partkey', 'p_name', STOP)},
ext AS (SELECT min(p_type) AS lo, max(p_type) AS hi FROM part)
SELECT p_type, term, CAST(sum(tf) AS BIGINT) AS tf FROM cnt JOIN part ON id = p_partkey, ext
WHERE p_type <> lo AND p_type <> hi GROUP BY p_type, term""")
def a01(spark, d):
    p = table(spark, d, "part")
    c = V.term_counts(p, "p_partkey", "p_name", stopword_list(STOP))
    return A.category_term_bags(c, p.select(F.col("p_partkey").alias("id"), "p_type"), "p_type")


@query("a02_label_frequency", """SELECT event_type AS label, count(*) AS n FROM
  (SELECT DISTINCT user_id, event_type FROM events) GROUP BY event_type""")
def a02(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("label"))
    return A.label_frequency(e)


@query("a03_labels_per_doc_histogram", """SELECT n_labels, count(*) AS n_docs FROM
  (SELECT l_orderkey, count(DISTINCT l_partkey) AS n_labels FROM lineitem GROUP BY l_orderkey) GROUP BY n_labels""")
def a03(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("label"))
    return A.labels_per_doc_histogram(li)


LABELS_LONG_SQL = """ll AS (SELECT doc_id AS id, 'quality' AS label, quality AS flag FROM labels
  UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)"""


def _labels_long(spark, d):
    l = table(spark, d, "labels")
    return l.unpivot(["doc_id"], ["quality", "toxic"], "label", "flag").withColumnRenamed("doc_id", "id")


@query("a04_class_sizes", f"""WITH {LABELS_LONG_SQL}
SELECT label, count(*) AS n FROM ll WHERE flag = 1 GROUP BY label""")
def a04(spark, d):
    return A.label_frequency(_labels_long(spark, d).filter("flag = 1"))


@query("a05_one_hot", """WITH ut AS (SELECT user_id, list(DISTINCT event_type) AS ts FROM events GROUP BY user_id),
cls AS (SELECT list(DISTINCT event_type ORDER BY event_type) AS cs FROM events)
SELECT user_id AS id, array_to_string(list_transform(cs, lambda c: CASE WHEN list_contains(ts, c) THEN 1 ELSE 0 END), ',')
  AS onehot FROM ut, cls""")
def a05(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("label"))
    classes = [r["label"] for r in bounded_rows(e.select("label").distinct().orderBy("label"), 100_000, "classes")]
    oh = A.one_hot(e, classes)
    return oh.select("id", F.concat_ws(",", F.col("onehot").cast("array<string>")).alias("onehot"))


@query("a06_inverse_one_hot", f"""WITH {LABELS_LONG_SQL}
SELECT id, coalesce(array_to_string(list_sort(list(label) FILTER (WHERE flag = 1)), ','), '') AS labels
FROM ll GROUP BY id""")
def a06(spark, d):
    inv = A.inverse_one_hot(_labels_long(spark, d))
    return inv.select("id", F.concat_ws(",", "labels").alias("labels"))


# Code-bearing free text derived from lineitem: per order, one code per line
# ('R03' from return flag + line number; open lines become process codes '-03').
A07_SQL = f"""WITH lc AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linestatus = 'O' THEN '-' ELSE l_returnflag END || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS c
  FROM lineitem),
t AS (SELECT l_orderkey AS id, string_agg(c, ', ' ORDER BY l_linenumber, c) AS text FROM lc GROUP BY l_orderkey)
SELECT * FROM (SELECT id, unnest(regexp_extract_all(text, '{T.CODE_PATTERN}')) AS code FROM t)
WHERE code NOT LIKE '-%'"""


@query("a07_flatten_codes", A07_SQL)
def a07(spark, d):
    li = table(spark, d, "lineitem")
    c = F.concat(F.when(F.col("l_linestatus") == "O", F.lit("-")).otherwise(F.col("l_returnflag")),
                 F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))
    t = (li.select(F.col("l_orderkey").alias("id"), "l_linenumber", c.alias("c")).groupBy("id")
         .agg(F.concat_ws(", ", F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "c"))),
                                            lambda e: e["c"])).alias("text")))
    return A.flatten_codes(t.select("id", T.extract_codes("text").alias("codes")), "id", "codes")


DOC_W_SQL = f"""{terms_cte('documents', 'doc_id', 'text', STOP)}, {tfidf_ctes('cnt', n='SELECT count(*) AS n FROM documents')},
{weights_cte('dw', 'cnt', 'v_vocab')}"""


def _doc_weights(spark, d):
    docs = table(spark, d, "documents")
    c = V.term_counts(docs, "doc_id", "text", stopword_list(STOP))
    return V.tfidf(c, V.fit_vocabulary(c, 5000, docs.count()))


@query("a08_common_terms", f"""WITH {DOC_W_SQL}
SELECT term, round(sum(w), 6) AS total_w FROM dw GROUP BY term HAVING sum(w) > 3""")
def a08(spark, d):
    return rounded(A.common_terms(_doc_weights(spark, d), 3.0))


@query("a09_top_terms_per_label", f"""WITH {DOC_W_SQL},
s AS (SELECT lang AS label, term, sum(w) AS w FROM dw JOIN documents ON id = doc_id GROUP BY lang, term)
SELECT label, term, round(w, 6) AS w, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY w DESC, term) AS rank FROM s) WHERE rank <= 10""")
def a09(spark, d):
    labels = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    return rounded(A.top_terms_per_label(_doc_weights(spark, d), labels, 10))


@query("a10_merge_chunk_predictions", f"""WITH {TURN_SQL}
SELECT conv_id, label, bool_or(pred) AS pred, round(max(score), 6) AS score FROM turns GROUP BY conv_id, label""")
def a10(spark, d):
    return rounded(A.merge_chunks(X.turn_scores(spark, d), "conv_id"))


@query("a11_supportive_chunks", f"""WITH {TURN_SQL}
SELECT conv_id, turn, arg_min(label, (-score, label)) AS label, round(max(score), 6) AS score
FROM turns GROUP BY conv_id, turn""")
def a11(spark, d):
    return rounded(A.supportive_chunks(X.turn_scores(spark, d), ["conv_id", "turn"]))


@query("a12_majority_class", """SELECT label, round(n / (SELECT count(*) FROM documents), 6) AS share FROM
  (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, label LIMIT 1)""")
def a12(spark, d):
    l = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    return rounded(A.majority_class(l))


@query("a14_overlapping_windows", """WITH n AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id),
w AS (SELECT c.conv_id, i.i, string_agg(c.text, ' ' ORDER BY c.turn) AS text, count(*) AS n_units
  FROM n JOIN (SELECT conv_id, unnest(range(2, CAST(n AS BIGINT))) AS i FROM n) i USING (conv_id)
  JOIN conversations c ON c.conv_id = i.conv_id AND c.turn >= i.i - 5 AND c.turn < least(i.i + 5, n.n)
  GROUP BY c.conv_id, i.i)
SELECT conv_id, CAST(i AS BIGINT) AS i, text, CAST(n_units AS BIGINT) AS n_units FROM w""")
def a14(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    w = A.overlapping_windows(c, "conv_id", "turn", "text", 2)
    return w.select("conv_id", F.col("i").cast("bigint"), "text", F.col("n_units").cast("bigint"))


@query("a15_first_n", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 200")
def a15(spark, d):
    return A.first_n(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 200)


# ------------------------------------------------------------------ chunking
MAX_TOK = 120


def pack_sql(units: str, max_tok: int = MAX_TOK) -> str:
    """Recursive-CTE twin of C01 over ``units(id, pos, s)`` (pos dense from 0)."""
    return f"""u2 AS (SELECT id, pos, s, len(regexp_extract_all(s, '\\S+')) AS t FROM {units}),
r AS (
  SELECT id, pos, CASE WHEN t < {max_tok} THEN 0 ELSE 1 END AS c, t AS prev FROM u2 WHERE pos = 0
  UNION ALL
  SELECT u2.id, u2.pos, CASE WHEN r.prev + u2.t < {max_tok} THEN r.c ELSE r.c + 1 END,
         CASE WHEN r.prev + u2.t < {max_tok} THEN r.prev + u2.t ELSE u2.t END
  FROM r JOIN u2 ON u2.id = r.id AND u2.pos = r.pos + 1),
ch AS (SELECT r.id, r.c, (CASE WHEN r.c = 0 THEN ' ' ELSE '' END) || string_agg(u2.s, ' ' ORDER BY u2.pos) AS text,
       count(*) AS n_units FROM r JOIN u2 USING (id, pos) GROUP BY r.id, r.c),
chunks AS (SELECT id, CAST(c - min(c) OVER (PARTITION BY id) AS BIGINT) AS chunk_id, text,
           CAST(n_units AS BIGINT) AS n_units FROM ch)"""


SENT_UNITS = f"""units AS (SELECT doc_id AS id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS s
  FROM (SELECT doc_id, regexp_extract_all(text, '{T.SENTENCE}') AS s FROM documents))"""


def _doc_chunks(spark, d, repair=False):
    docs = table(spark, d, "documents")
    txt = T.repair_sentence_breaks("text") if repair else F.col("text")
    s = docs.select(F.col("doc_id").alias("id"), "lang", T.sentences(txt).alias("units"))
    ch = C.pack_units(s, ["id", "lang"], "units", MAX_TOK)
    return ch.select("id", "lang", F.col("chunk_id").cast("bigint"), "text", F.col("n_units").cast("bigint"))


@query("c01_pack_sentences", f"""WITH RECURSIVE {SENT_UNITS}, {pack_sql('units')}
SELECT id, chunk_id, text, n_units FROM chunks""")
def c01(spark, d):
    return _doc_chunks(spark, d).drop("lang")


@query("c01_pack_rows", f"""WITH RECURSIVE {SENT_UNITS}, {pack_sql('units')}
SELECT id, chunk_id, text, n_units FROM chunks""")
def c01_rows(spark, d):
    """The same chunks from sentences as rows: next-chunk pointers and pointer doubling, for documents of any length."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    ch = C.pack_rows(docs, MAX_TOK)
    return ch.select("id", F.col("chunk_id").cast("bigint"), "text", F.col("n_units").cast("bigint"))


@query("c02_labelled_chunks", f"""WITH RECURSIVE {SENT_UNITS}, {pack_sql('units')}
SELECT c.id, c.chunk_id, d.lang AS label, CAST(count(*) OVER (PARTITION BY c.id) AS BIGINT) AS n_chunks
FROM chunks c JOIN documents d ON d.doc_id = c.id""")
def c02(spark, d):
    ch = C.chunk_count(_doc_chunks(spark, d), ["id"])
    return ch.select("id", "chunk_id", F.col("lang").alias("label"), F.col("n_chunks").cast("bigint"))


C03_SEED = 11


@query("c03_description_chunk_split", f"""WITH RECURSIVE units AS (
  SELECT doc_id AS id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS s
  FROM (SELECT doc_id, regexp_extract_all({t06_expr('text')}, '{T.SENTENCE}') AS s FROM documents)),
{pack_sql('units')},
k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM chunks) WHERE n > 2),
h AS (SELECT id, chunk_id, {sql_hash(C03_SEED, 'id', 'chunk_id')} AS h, n FROM k)
SELECT id, chunk_id, row_number() OVER (PARTITION BY id ORDER BY h, chunk_id) <= ceil(n * 0.2) AS is_test FROM h""")
def c03(spark, d):
    ch = C.keep_docs_with_chunks(_doc_chunks(spark, d, repair=True), "id", 2)
    h = ch.withColumn("_h", stable_hash(C03_SEED, "id", "chunk_id"))
    r = grouped_rank(h, ["id"], "_h", "chunk_id")
    return r.select("id", "chunk_id", (F.col("rn") <= F.ceil(F.col("grp_n") * 0.2)).alias("is_test"))


@query("c04_transcript_chunks", f"""WITH RECURSIVE units AS (
  SELECT conv_id AS id, turn AS pos, text AS s FROM conversations), {pack_sql('units')}
SELECT id, chunk_id, text, n_units FROM chunks""")
def c04(spark, d):
    from ..operators.structure import turn_list
    conv = turn_list(table(spark, d, "conversations"), "conv_id", "turn", "text")
    ch = C.pack_units(conv.withColumnRenamed("conv_id", "id"), ["id"], "units", MAX_TOK)
    return ch.select("id", F.col("chunk_id").cast("bigint"), "text", F.col("n_units").cast("bigint"))
