"""Registered queries: vectorisation, multinomial NB, core evaluation, flagship run."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stopwords import stopword_list
from ..operators import evaluate as E
from ..operators import vectorize as V
from ..sources.tables import table
from . import experiments as X
from .registry import query, rounded
from .sqlkit import (group_split_cte, nb_ctes, nb_score_ctes, prf_ctes, stop_sql,
                     terms_cte, tfidf_ctes, weights_cte)

STOP = "ce"
N_DOCS = "SELECT count(*) AS n FROM documents"
N_DESC = "SELECT count(DISTINCT label) AS n FROM s WHERE is_test"

# ---------------------------------------------------------------- shared SQL
SPLIT_SQL = group_split_cte("s", "(SELECT doc_id AS id, lang AS label FROM documents)", "label", "id",
                            X.DESC_FRACTION, X.DESC_SEED)


def distant_sql(stop: str = STOP, label: str = "lang", drop_label: str | None = None, src: str = "documents") -> str:
    """Oracle twin of :func:`experiments.distant_setup` + NB fit and scores."""
    split = group_split_cte("s", f"(SELECT doc_id AS id, {label} AS label FROM documents"
                            + (f" WHERE {label} <> '{drop_label}'" if drop_label else "") + ")",
                            "label", "id", X.DESC_FRACTION, X.DESC_SEED)
    return f"""{split},
{terms_cte(src, 'doc_id', 'text', stop, 'cnt')},
dc AS (SELECT s.label AS id, term, sum(tf) AS tf FROM cnt JOIN s USING (id) WHERE s.is_test GROUP BY s.label, term),
{tfidf_ctes('dc', 'v', X.MAX_FEATURES, N_DESC)},
{weights_cte('dw', 'dc', 'v_vocab')},
tc AS (SELECT id, term, tf FROM cnt JOIN s USING (id) WHERE NOT s.is_test),
{weights_cte('tw', 'tc', 'v_vocab')},
tids AS (SELECT id, label FROM s WHERE NOT is_test),
ty AS (SELECT DISTINCT id, id AS label FROM dw),
{nb_ctes('dw', 'ty', 'v_vocab')},
{nb_score_ctes('tids', 'tw')}"""


DISTANT_SQL = distant_sql()


@query("v01_word_tokens", f"""WITH {terms_cte('documents', 'doc_id', 'text', STOP)}
SELECT id AS doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens FROM cnt_tok""")
def v01(spark, d):
    toks = V.word_tokens(F.col("text"), stopword_list(STOP))
    return table(spark, d, "documents").select(
        "doc_id", F.size(toks).cast("bigint").alias("n_tokens"), F.concat_ws(" ", toks).alias("tokens"))


@query("v02_term_counts", f"""WITH {terms_cte('documents', 'doc_id', 'text', STOP)}
SELECT id AS doc_id, term, tf FROM cnt""")
def v02(spark, d):
    return (V.term_counts(table(spark, d, "documents"), "doc_id", "text", stopword_list(STOP))
            .withColumnRenamed("id", "doc_id"))


@query("v03_vocabulary", f"""WITH {terms_cte('documents', 'doc_id', 'text', STOP)}, {tfidf_ctes('cnt', n=N_DOCS)}
SELECT term, CAST(total AS BIGINT) AS total, CAST(df AS BIGINT) AS df FROM v_vocab""")
def v03(spark, d):
    docs = table(spark, d, "documents")
    c = V.term_counts(docs, "doc_id", "text", stopword_list(STOP))
    return V.fit_vocabulary(c, 5000, docs.count()).select("term", "total", "df")


@query("v04_idf", f"""WITH {terms_cte('documents', 'doc_id', 'text', STOP)}, {tfidf_ctes('cnt', n=N_DOCS)}
SELECT term, round(idf, 6) AS idf FROM v_vocab""")
def v04(spark, d):
    docs = table(spark, d, "documents")
    c = V.term_counts(docs, "doc_id", "text", stopword_list(STOP))
    return rounded(V.fit_vocabulary(c, 5000, docs.count()).select("term", "idf"))


@query("v05_tfidf_transform", f"""WITH {terms_cte('documents', 'doc_id', 'text', STOP)}, {tfidf_ctes('cnt', n=N_DOCS)},
{terms_cte('conversations', "conv_id || ':' || turn", 'text', STOP, 'cc')},
{weights_cte('cw', 'cc', 'v_vocab')}
SELECT id, term, round(w, 6) AS w FROM cw""")
def v05(spark, d):
    stop = stopword_list(STOP)
    docs = table(spark, d, "documents")
    vocab = V.fit_vocabulary(V.term_counts(docs, "doc_id", "text", stop), 5000, docs.count())
    conv = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("tid"), "text")
    return rounded(V.tfidf(V.term_counts(conv, "tid", "text", stop), vocab))


@query("v06_cosine_to_classes", f"""WITH {DISTANT_SQL},
cos AS (SELECT t.id, d.id AS label, sum(t.w * d.w) AS cosine FROM tw t JOIN dw d USING (term) GROUP BY t.id, d.id)
SELECT id, label, round(cosine, 6) AS cosine FROM cos""")
def v06(spark, d):
    s = X.distant_setup(spark, d)
    return rounded(V.cosine_to_classes(s.test_raw, s.desc_w, raw=True))


@query("v07_density", f"""WITH {DISTANT_SQL}
SELECT round(count(*) / ((SELECT count(*) FROM tids) * (SELECT count(*) FROM v_vocab)), 6) AS density FROM tw""")
def v07(spark, d):
    s = X.distant_setup(spark, d)
    n_docs = s.test_ids.count()
    return rounded(V.density(s.test_raw, n_docs, s.vocab_size))


@query("m01_multinomial_nb", f"""WITH {DISTANT_SQL}
SELECT id, label, score > 0.1 AS pred, round(score, 6) AS score FROM scores""")
def m01(spark, d):
    return rounded(X.distant_nb(X.distant_setup(spark, d)))


@query("e01_per_class_prf", f"""WITH {DISTANT_SQL},
pred AS (SELECT id, label FROM scores WHERE score > 0.1),
{prf_ctes('tids', 'pred')}
SELECT label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM pc""")
def e01(spark, d):
    s = X.distant_setup(spark, d)
    return rounded(E.per_class(s.gold, X.distant_nb(s)))


@query("e02_macro_prf", f"""WITH {DISTANT_SQL},
pred AS (SELECT id, label FROM scores WHERE score > 0.1),
{prf_ctes('tids', 'pred')}
SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM pc""")
def e02(spark, d):
    s = X.distant_setup(spark, d)
    return rounded(E.evaluate(s.gold, X.distant_nb(s)))


@query("r01_distant_supervision_nb", f"""WITH {DISTANT_SQL},
pred AS (SELECT id, label FROM scores WHERE score > 0.1),
{prf_ctes('tids', 'pred')}
SELECT 'mnb' AS method, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(f1), 6) AS f1 FROM pc""")
def r01(spark, d):
    return rounded(X.distant_run(spark, d, "mnb"))


@query("x01_group_split", f"""WITH {SPLIT_SQL}
SELECT id, label, is_test FROM s""")
def x01(spark, d):
    from ..operators.sample import group_split
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    return group_split(docs, ["label"], "id", X.DESC_FRACTION, X.DESC_SEED).select("id", "label", "is_test")
