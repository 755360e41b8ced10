"""Registered queries: T04, T17, U03, M13, S14, S20, S23, S24."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stopwords import stopword_list
from ..operators import aggregate as A
from ..operators import evaluate as E
from ..operators import structure as D
from ..sources import io as S
from ..sources.tables import table
from . import experiments as X
from .q_aggregate import TURN_SQL
from .q_core import distant_sql
from .registry import query, rounded
from .sqlkit import prf_ctes, stop_sql

WORDS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: len(x) > 0)"


@query("t04_lemmatise", f"""WITH w AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS token FROM (
  SELECT doc_id, {WORDS} AS l FROM documents)),
lem AS (SELECT DISTINCT token AS form, left(token, length(token) - 1) AS lemma FROM w
  WHERE length(token) > 3 AND ends_with(token, 's'))
SELECT doc_id AS id, string_agg(coalesce(lemma, token), ' ' ORDER BY pos) AS text
FROM w LEFT JOIN lem ON lem.form = w.token GROUP BY doc_id""")
def t04(spark, d):
    docs = table(spark, d, "documents")
    w = docs.select(F.col("doc_id").alias("id"), F.posexplode(T.lower_words("text")).alias("pos", "token"))
    lem = (w.filter((F.length("token") > 3) & F.col("token").endswith("s"))
           .select(F.col("token").alias("form"), F.expr("left(token, length(token) - 1)").alias("lemma")).distinct())
    return D.lemmatise(w, lem)


@query("t17_stopword_sets", " UNION ALL ".join(
    f"""SELECT '{st}' AS setting, CAST(sum(len(list_filter({WORDS}, lambda x: list_contains({stop_sql(st)}, x))))
  AS BIGINT) AS removed FROM documents""" for st in ("c", "e", "ce")))
def t17(spark, d):
    docs = table(spark, d, "documents")
    out = None
    for st in ("c", "e", "ce"):
        words = stopword_list(st)  # unique, normalised union of the chosen sets
        r = docs.agg(F.sum(F.size(F.filter(T.lower_words("text"), lambda x: x.isin(words)))).cast("bigint").alias("removed")) \
            .select(F.lit(st).alias("setting"), "removed")
        out = r if out is None else out.unionByName(r)
    return out


@query("u03_functions_over_turns", f"""SELECT conv_id, turn, lower(role) AS speaker,
  array_to_string({WORDS}, ' ') AS utterance FROM conversations""")
def u03(spark, d):
    c = table(spark, d, "conversations")
    arr = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("turn", F.col("role").alias("speaker"), F.col("text").alias("utterance")))).alias("t"))
    m = arr.select("conv_id", F.col("t.turn").alias("turns"),
                   D.apply_to_turns("t", F.lower, lambda u: T.join_words(T.lower_words(u))).alias("m"))
    z = m.select("conv_id", F.inline(F.arrays_zip(F.col("turns").alias("turn"), F.col("m").alias("x"))))
    return z.select("conv_id", "turn", F.col("x.speaker").alias("speaker"), F.col("x.utterance").alias("utterance"))


@query("s14_read_eval_json", f"""SELECT CAST(doc_id AS VARCHAR) AS id,
  len(regexp_extract_all(text, '{T.SENTENCE}')) AS split_nums, lang AS codes FROM documents""")
def s14(spark, d):
    docs = table(spark, d, "documents")
    js = docs.select(F.to_json(F.array(F.to_json(T.sentences("text")), F.to_json(F.array("lang")),
                                       F.col("doc_id").cast("string"))).alias("js"))
    r = S.read_eval_json(js, "js")
    return r.select("id", "split_nums", F.concat_ws(",", "codes").alias("codes"))


@query("s20_supportive_chunks_tsv", f"""WITH {TURN_SQL},
b AS (SELECT conv_id, turn, arg_min(label, (-score, label)) AS category, max(score) AS probability FROM turns
  GROUP BY conv_id, turn)
SELECT b.category, c.text AS chunks, round(b.probability, 6) AS probability FROM b
JOIN conversations c ON c.conv_id = b.conv_id AND c.turn = b.turn""")
def s20(spark, d):
    sc = X.turn_scores(spark, d)
    best = A.supportive_chunks(sc, ["conv_id", "turn"])
    conv = table(spark, d, "conversations").select("conv_id", "turn", "text")
    out = best.join(conv, ["conv_id", "turn"]).select(F.col("label").alias("category"), F.col("text").alias("chunks"),
                                                      F.round("score", 6).alias("probability"))
    path = S.scratch_path(spark, "supportive")
    S.write_tsv(out, path)
    return spark.read.schema(out.schema).option("header", True).option("sep", "\t").option("multiLine", True).csv(path)


@query("s23_fine_prediction_table", f"""WITH {distant_sql(label='source')},
best AS (SELECT id, arg_min(label, (-round(score, 12), label)) AS topic FROM scores GROUP BY id)
SELECT b.id AS record_id, d.lang AS codes, b.topic FROM best b JOIN documents d ON d.doc_id = b.id""")
def s23(spark, d):
    from ..operators import classify as M
    s = X.distant_setup(spark, d, label_col="source")
    p = M.argmax(X.distant_nb(s).withColumn("score", F.round("score", 12))).filter("pred")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("lang").alias("codes"))
    out = p.select(F.col("id").alias("record_id"), F.col("label").alias("topic")).join(docs, "record_id")
    path = S.scratch_path(spark, "fine_pred")
    S.write_tsv(out.select("record_id", "codes", "topic"), path)
    return spark.read.schema("record_id bigint, codes string, topic string").option("header", True) \
        .option("sep", "\t").csv(path)


@query("s24_topic_codes_table", """SELECT p_type AS cks_topic, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS icpc_codes
FROM part GROUP BY p_type""")
def s24(spark, d):
    p = table(spark, d, "part")
    per = p.groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("ts"))
    inv = S.invert_mapping(per.select(F.to_json(F.create_map("p_brand", "ts")).alias("js")), "code", "js")
    out = inv.select(F.col("topic").alias("cks_topic"), F.concat_ws(",", "codes").alias("icpc_codes"))
    path = S.scratch_path(spark, "topic_codes")
    S.write_tsv(out, path)
    return spark.read.schema("cks_topic string, icpc_codes string").option("header", True).option("sep", "\t").csv(path)
