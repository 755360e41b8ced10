"""Registered queries: string/array scalars T01-T19 (whole texts, whole tables)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stopwords import stopword_list
from ..sources.tables import table
from .registry import query, rounded
from .sqlkit import stop_sql

STOP = "ce"
WORDS_SQL = "list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda x: len(x) > 0)"
# Fixed values for the heading filter query (wanted headings; a caller parameter).
WANTED_TYPES = ["SMALL PLATED BRASS AND ECONOMY BURNISHED NICKEL", "PROMO POLISHED STEEL", "LARGE BRUSHED"]


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("t01_lower_words", f"""SELECT doc_id, array_to_string({WORDS_SQL.format(c='text')}, ' ') AS text
FROM documents""")
def t01(spark, d):
    return _docs(spark, d).select("doc_id", T.join_words(T.lower_words("text")).alias("text"))


@query("t02_strip_punctuation", """SELECT doc_id,
  translate(regexp_replace(lower(text), '([/.,?!:])([a-zA-Z])', '\\1 \\2', 'g'),
            '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', '') AS text FROM documents""")
def t02(spark, d):
    return _docs(spark, d).select("doc_id", T.strip_punctuation(F.lower("text")).alias("text"))


@query("t03_remove_stopwords", f"""SELECT doc_id, array_to_string(list_filter({WORDS_SQL.format(c='text')},
  lambda x: NOT list_contains({stop_sql(STOP)}, x)), ' ') AS text FROM documents""")
def t03(spark, d):
    w = T.remove_words(T.lower_words("text"), stopword_list(STOP))
    return _docs(spark, d).select("doc_id", T.join_words(w).alias("text"))


@query("t05_remove_questions_brackets", """SELECT doc_id,
  regexp_replace(regexp_replace(text, '\\[.*?]', '', 'g'), '[\\w|\\s]*?\\?', '', 'g') AS text FROM documents""")
def t05(spark, d):
    return _docs(spark, d).select("doc_id", T.remove_questions(T.remove_brackets("text")).alias("text"))


def t06_expr(col: str = "text") -> str:
    t = col
    for m in (".", "?", "!"):
        pat = f"([a-zA-Z])(\\{m}|\\s\\{m})([a-zA-Z])"
        for _ in range(2):  # two passes cover overlapping single-letter runs
            t = f"regexp_replace({t}, '{pat}', '\\1{m} \\3', 'g')"
    return t


@query("t06_repair_sentence_breaks", f"SELECT doc_id, {t06_expr()} AS text FROM documents")
def t06(spark, d):
    return _docs(spark, d).select("doc_id", T.repair_sentence_breaks("text").alias("text"))


@query("t07_sentences", f"""SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS sent_no,
  unnest(s) AS sentence FROM (SELECT doc_id, regexp_extract_all(text, '{T.SENTENCE}') AS s FROM documents)""")
def t07(spark, d):
    s = _docs(spark, d).select("doc_id", T.sentences("text").alias("s"))
    return s.select("doc_id", F.posexplode("s").alias("sent_no", "sentence")).select(
        "doc_id", F.col("sent_no").cast("bigint"), "sentence")


@query("t08_clean_description", f"""SELECT doc_id, array_to_string(list_filter(
  {WORDS_SQL.format(c="regexp_replace(regexp_replace(text, '\\[.*?]', '', 'g'), '[\\w|\\s]*?\\?', '', 'g')")},
  lambda x: NOT list_contains({stop_sql(STOP)}, x)), ' ') AS text FROM documents""")
def t08(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_description("text", stopword_list(STOP)).alias("text"))


@query("t09_preprocess_text", f"""SELECT doc_id, array_to_string(list_filter(list_filter(
  {WORDS_SQL.format(c="translate(regexp_replace(lower(text), '([/.,?!:])([a-zA-Z])', '\\1 \\2', 'g'), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', '')")},
  lambda x: NOT list_contains({stop_sql('c')}, x)), lambda x: NOT list_contains({stop_sql('e')}, x)), ' ') AS text
FROM documents""")
def t09(spark, d):
    return _docs(spark, d).select("doc_id", T.preprocess("text", stopword_list("c"), stopword_list("e"),
                                                       remove_punct=True).alias("text"))


@query("t10_code_categories", """SELECT p_partkey, array_to_string(list_filter(list_transform(
  string_split(p_type, ' '), lambda c: upper(trim(left(c, 1)))), lambda c: c <> '-'), ',') AS cats FROM part""")
def t10(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.concat_ws(",", T.code_categories(F.split("p_type", " "))).alias("cats"))


@query("t11_extract_codes", f"""SELECT doc_id, array_to_string(coalesce(regexp_extract_all(text, '{T.CODE_PATTERN}'),
  []), ',') AS codes FROM documents""")
def t11(spark, d):
    return _docs(spark, d).select("doc_id", F.concat_ws(",", T.extract_codes("text")).alias("codes"))


@query("t12_drop_uncoded", """SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id)""")
def t12(spark, d):
    lab = table(spark, d, "labels").select("doc_id")
    return table(spark, d, "documents").select("doc_id").join(lab, "doc_id", "left_semi")


@query("t13_heading_filter", f"""SELECT p_partkey, p_type FROM part
WHERE len(list_filter({[w for w in WANTED_TYPES]}, lambda w: contains(w, p_type))) > 0""")
def t13(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type")
    return p.filter(T.heading_wanted("p_type", WANTED_TYPES))


@query("t14_id_fallback", """WITH k AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN lpad(CAST(o_custkey AS VARCHAR), 10, '0')
                          ELSE CAST(o_custkey AS VARCHAR) END AS rec FROM orders),
c AS (SELECT CAST(c_custkey AS VARCHAR) AS rec, c_name FROM customer)
SELECT k.o_orderkey, k.rec, coalesce(a.c_name, b.c_name) AS c_name
FROM k LEFT JOIN c a ON a.rec = k.rec LEFT JOIN c b ON b.rec = ltrim(k.rec, '0')""")
def t14(spark, d):
    from ..operators.relate import lookup_with_fallback
    o = table(spark, d, "orders")
    k = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F",
                                      F.lpad(F.col("o_custkey").cast("string"), 10, "0"))
                 .otherwise(F.col("o_custkey").cast("string")).alias("rec"))
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("rec"), "c_name")
    return lookup_with_fallback(k, c, "rec", ["c_name"])


@query("t15_docs_with_many_chunks", f"""SELECT doc_id FROM documents
WHERE len(regexp_extract_all(text, '{T.SENTENCE}')) > 2""")
def t15(spark, d):
    from ..operators.chunk import keep_docs_with_chunks
    s = _docs(spark, d).select("doc_id", F.posexplode(T.sentences("text")).alias("chunk_id", "t"))
    return keep_docs_with_chunks(s, "doc_id", 2).select("doc_id").distinct()


@query("t16_concat_nullable", """SELECT c_custkey, concat_ws(' ', coalesce(c_name, ''), coalesce(c_mktsegment, ''))
  AS text FROM customer""")
def t16(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", T.concat_nullable("c_name", "c_mktsegment").alias("text"))


EMB_LONG = """emb AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos,
  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


@query("t18_softmax", f"""WITH {EMB_LONG},
e AS (SELECT vec_id, pos, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM emb)
SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM e""")
def t18(spark, d):
    e = T.with_softmax(table(spark, d, "embeddings"), "embedding", "p").select("vec_id", "p")
    return rounded(e.select("vec_id", F.posexplode("p").alias("pos", "p")).select(
        "vec_id", F.col("pos").cast("bigint"), "p"))


@query("t19_expit", f"""WITH {EMB_LONG}
SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(1 / (1 + exp(-x)), 6) AS p FROM emb""")
def t19(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: T.expit(x.cast("double"))).alias("p"))
    return rounded(e.select("vec_id", F.posexplode("p").alias("pos", "p")).select(
        "vec_id", F.col("pos").cast("bigint"), "p"))
