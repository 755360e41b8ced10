"""Registered queries: classifiers M02-M14."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as M
from ..operators.sample import group_split
from ..sources.tables import table
from . import experiments as X
from .q_core import DISTANT_SQL
from .registry import query, rounded
from .sqlkit import sql_hash

EMB_SEED = 41

BNB_SQL = f"""{DISTANT_SQL},
bn_n AS (SELECT count(DISTINCT id) AS n FROM ty),
bn_tt AS (SELECT term, sum(w) AS T_t FROM dw GROUP BY term),
bn_T AS (SELECT sum(T_t) AS T FROM bn_tt),
bn_nct AS (SELECT y.label, w.term, sum(w.w) AS n_ct FROM dw w JOIN ty y USING (id) GROUP BY y.label, w.term),
bn_nc AS (SELECT label, sum(n_ct) AS n_c FROM bn_nct GROUP BY label),
bn_np AS (SELECT label, count(*) AS n_pos FROM ty GROUP BY label),
bn_cls AS (SELECT p.label, ln(0.001) - ln(coalesce(n_c, 0) + 0.001 * v) AS kpos,
  -ln(T - coalesce(n_c, 0) + 0.001 * v) AS kneg, ln(n_pos / n) AS ppos, ln((n - n_pos) / n) AS pneg
  FROM bn_np p LEFT JOIN bn_nc USING (label), bn_n, bn_T, nb_V),
bn_model AS (SELECT label, term, ln(n_ct + 0.001) - ln(0.001) AS dpos, ln(T_t - n_ct + 0.001) - ln(T_t + 0.001) AS dneg
  FROM bn_nct JOIN bn_tt USING (term)),
bn_lt AS (SELECT term, ln(coalesce(T_t, 0) + 0.001) AS lt FROM v_vocab LEFT JOIN bn_tt USING (term)),
bn_part AS (SELECT id, label, sum(w * dpos) AS sp, sum(w * dneg) AS sn FROM tw JOIN bn_model USING (term) GROUP BY id, label),
bn_doc AS (SELECT id, sum(w) AS W, sum(w * lt) AS A FROM tw JOIN bn_lt USING (term) GROUP BY id),
bn_j AS (SELECT t.id, c.label, coalesce(W, 0) * kpos + coalesce(sp, 0) + ppos AS jp,
  coalesce(A, 0) + coalesce(W, 0) * kneg + coalesce(sn, 0) + pneg AS jn
  FROM (SELECT DISTINCT id FROM tids) t CROSS JOIN bn_cls c LEFT JOIN bn_doc d ON d.id = t.id
  LEFT JOIN bn_part p ON p.id = t.id AND p.label = c.label)"""


def _bnb(spark, d):
    s = X.distant_setup(spark, d)
    train_y = s.desc_w.select("id").distinct().withColumn("label", F.col("id"))
    return M.binary_nb(s.desc_w, train_y, s.test_ids, s.test_x, s.vocab, s.vocab_size)


@query("m02_binary_nb", f"""WITH {BNB_SQL}
SELECT id, label, 1 / (1 + exp(jn - jp)) > 0.1 AS pred, round(1 / (1 + exp(jn - jp)), 6) AS score FROM bn_j""")
def m02(spark, d):
    return rounded(_bnb(spark, d))


EMB_SPLIT = f"""es AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS v,
  row_number() OVER (PARTITION BY label ORDER BY {sql_hash(EMB_SEED, 'vec_id')}, vec_id) AS rn,
  count(*) OVER (PARTITION BY label) AS n FROM embeddings),
te AS (SELECT vec_id, label, v FROM es WHERE rn <= ceil(n * 0.2)),
tr AS (SELECT vec_id, label, v FROM es WHERE rn > ceil(n * 0.2))"""


def _emb_split(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"),
                                             "embedding")
    s = group_split(e, ["label"], "id", 0.2, EMB_SEED)
    return (s.filter(~F.col("is_test")).select("id", "label", F.col("embedding").alias("vec")),
            s.filter("is_test").select("id", "label", F.col("embedding").alias("vec")))


@query("m05_nearest_centroid", f"""WITH {EMB_SPLIT},
trl AS (SELECT label, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM tr),
cent AS (SELECT label, dim, avg(x) AS c FROM trl GROUP BY label, dim),
tel AS (SELECT vec_id, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM te),
dd AS (SELECT vec_id, label, sum((x - c) * (x - c)) AS d2 FROM tel JOIN cent USING (dim) GROUP BY vec_id, label),
best AS (SELECT vec_id, arg_min(label, (d2, label)) AS best FROM dd GROUP BY vec_id)
SELECT vec_id AS id, label, label = best AS pred, CASE WHEN label = best THEN 1.0 ELSE 0.0 END AS score
FROM dd JOIN best USING (vec_id)""")
def m05(spark, d):
    tr, te = _emb_split(spark, d)
    return M.nearest_centroid_dense(tr, te, "vec")


@query("m05_nearest_centroid_tfidf", f"""WITH {DISTANT_SQL},
cent AS (SELECT id AS label, term, w AS c FROM dw),
cn AS (SELECT label, sum(c * c) AS cc FROM cent GROUP BY label),
dots AS (SELECT t.id, c.label, sum(t.w * c.c) AS dot FROM tw t JOIN cent c USING (term) GROUP BY t.id, c.label),
xx AS (SELECT id, sum(w * w) AS xx FROM tw GROUP BY id),
dd AS (SELECT t.id, cn.label, coalesce(xx.xx, 0) - 2 * coalesce(dots.dot, 0) + cn.cc AS d2
  FROM (SELECT DISTINCT id FROM tids) t CROSS JOIN cn LEFT JOIN xx ON xx.id = t.id
  LEFT JOIN dots ON dots.id = t.id AND dots.label = cn.label),
best AS (SELECT id, arg_min(label, (round(d2, 9), label)) AS best FROM dd GROUP BY id)
SELECT id, label, label = best AS pred, CASE WHEN label = best THEN 1.0 ELSE 0.0 END AS score FROM dd JOIN best USING (id)""")
def m05s(spark, d):
    s = X.distant_setup(spark, d)
    train_y = s.desc_w.select("id").distinct().withColumn("label", F.col("id"))
    return M.nearest_centroid_sparse(s.desc_w, train_y, s.test_ids, s.test_x)


@query("m06_knn_cosine", f"""WITH {EMB_SPLIT},
pairs AS (SELECT te.vec_id AS qid, tr.vec_id AS rid, tr.label, 1 - list_cosine_similarity(te.v, tr.v) AS dist FROM te, tr),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS r FROM pairs) WHERE r <= 3),
ex AS (SELECT qid, max(CASE WHEN dist <= 0 THEN 1 ELSE 0 END) AS ex FROM top GROUP BY qid),
wt AS (SELECT top.qid, label, CASE WHEN ex = 1 THEN (CASE WHEN dist <= 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 / dist END AS wt
  FROM top JOIN ex USING (qid)),
agg AS (SELECT qid, label, sum(wt) AS ws FROM wt GROUP BY qid, label),
prob AS (SELECT qid, label, ws / sum(ws) OVER (PARTITION BY qid) AS score FROM agg),
best AS (SELECT qid, arg_min(label, (-score, label)) AS best FROM prob GROUP BY qid)
SELECT qid AS id, label, label = best AS pred, round(score, 6) AS score FROM prob JOIN best USING (qid)""")
def m06(spark, d):
    tr, te = _emb_split(spark, d)
    return rounded(M.knn_cosine(tr, te.select("id", "vec"), 3, "vec", block_rows=128))


@query("m07_pad_absent_classes", f"""WITH {DISTANT_SQL.replace("ty AS (SELECT DISTINCT id, id AS label FROM dw)",
                                                        "ty AS (SELECT DISTINCT id, id AS label FROM dw WHERE id <> 'es')")},
allc AS (SELECT DISTINCT label FROM s)
SELECT t.id, a.label, coalesce(sc.score > 0.1, false) AS pred, round(coalesce(sc.score, 0.0), 6) AS score
FROM (SELECT DISTINCT id FROM tids) t CROSS JOIN allc a LEFT JOIN scores sc ON sc.id = t.id AND sc.label = a.label""")
def m07(spark, d):
    s = X.distant_setup(spark, d)
    desc = s.desc_w.filter(F.col("id") != "es")
    train_y = desc.select("id").distinct().withColumn("label", F.col("id"))
    pred = M.multinomial_nb(desc, train_y, s.test_ids, s.test_x, s.vocab_size)
    return rounded(M.pad_classes(pred, s.test_ids, s.split.select("label")))


@query("m08_argmax", f"""WITH {DISTANT_SQL},
best AS (SELECT id, arg_min(label, (-round(score, 12), label)) AS best FROM scores GROUP BY id)
SELECT id, label, label = best AS pred, round(score, 6) AS score FROM scores JOIN best USING (id)""")
def m08(spark, d):
    s = X.distant_setup(spark, d)
    sc = X.distant_nb(s).withColumn("score", F.round("score", 12))
    return rounded(M.argmax(sc))


EMB_LONG = """el AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings)"""
M09_POS = list(range(64))


@query("m09_class_word_projection", f"""WITH {EMB_LONG},
s AS (SELECT vec_id, pos AS k, x FROM el),
e AS (SELECT vec_id, k, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM s),
p AS (SELECT vec_id, k, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e),
b AS (SELECT vec_id, arg_min(k, (-p, k)) AS k, max(p) AS prob FROM p GROUP BY vec_id)
SELECT vec_id, CASE WHEN prob >= 0.2 THEN CAST(k AS INTEGER) END AS label_idx, round(prob, 6) AS prob FROM b""")
def m09(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", M.class_word_projection(F.col("embedding"), M09_POS, 0.2).alias("r"))
    return rounded(e.select("vec_id", F.col("r.label_idx").cast("int").alias("label_idx"), F.col("r.prob").alias("prob")))


@query("m10_pairwise_decisions", f"""WITH {EMB_LONG},
pn AS (SELECT vec_id, pos // 2 AS label, max(CASE WHEN pos % 2 = 0 THEN x END) AS pos_l,
  max(CASE WHEN pos % 2 = 1 THEN x END) AS neg_l FROM el GROUP BY vec_id, pos // 2),
e AS (SELECT *, exp(pos_l - max(pos_l) OVER (PARTITION BY vec_id)) AS e FROM pn)
SELECT vec_id, CAST(label AS INTEGER) AS label, pos_l > neg_l AS pred, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS prob
FROM e""")
def m10(spark, d):
    from ..operators.classify import pairwise_decisions
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return rounded(pairwise_decisions(e, "vec_id", "embedding", 32))


@query("m11_argmax_softmax", f"""WITH {EMB_LONG},
s AS (SELECT vec_id, pos, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM el),
p AS (SELECT vec_id, pos, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM s)
SELECT vec_id, CAST(arg_min(pos, (-p, pos)) AS INTEGER) AS label, round(max(p), 6) AS prob FROM p GROUP BY vec_id""")
def m11(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", T.softmax(F.col("embedding")).alias("p"))
    return rounded(e.select("vec_id", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("label"),
                            F.array_max("p").alias("prob")))


@query("m12_ensemble", f"""WITH {EMB_LONG},
s AS (SELECT vec_id, pos // 16 AS model, pos % 16 AS label, x FROM el),
e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id, model)) AS e FROM s),
p AS (SELECT vec_id, model, label, e / sum(e) OVER (PARTITION BY vec_id, model) AS p FROM e),
mb AS (SELECT vec_id, model, arg_min(label, (-p, label)) AS best FROM p GROUP BY vec_id, model),
votes AS (SELECT vec_id, best AS label, count(*) AS votes FROM mb GROUP BY vec_id, best),
avgp AS (SELECT vec_id, label, avg(p) AS avg_score FROM p GROUP BY vec_id, label),
b AS (SELECT vec_id, arg_min(label, (-avg_score, label)) AS best FROM avgp GROUP BY vec_id)
SELECT a.vec_id, CAST(a.label AS INTEGER) AS label, round(a.avg_score, 6) AS avg_score, a.label = b.best AS pred_mean,
  coalesce(v.votes, 0) >= 2 AS pred_vote
FROM avgp a JOIN b USING (vec_id) LEFT JOIN votes v ON v.vec_id = a.vec_id AND v.label = a.label""")
def m12(spark, d):
    from ..operators.classify import ensemble
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    parts = []
    for m in range(4):
        p = e.select(F.col("vec_id").alias("id"), T.softmax(F.slice("embedding", 16 * m + 1, 16)).alias("p"))
        parts.append(p.select("id", F.lit(m).alias("model"), F.posexplode("p").alias("label", "score")))
    out = ensemble(parts)
    return rounded(out.select(F.col("id").alias("vec_id"), F.col("label").cast("int"), "avg_score", "pred_mean", "pred_vote"))


@query("m14_term_posteriors", f"""WITH {DISTANT_SQL},
lp AS (SELECT v.term, c.label, c.base + coalesce(m.delta, 0) AS lp FROM v_vocab v CROSS JOIN nb_cls c
  LEFT JOIN nb_model m ON m.term = v.term AND m.label = c.label),
e AS (SELECT term, label, exp(lp - max(lp) OVER (PARTITION BY term)) AS e FROM lp)
SELECT term, label, round(e / sum(e) OVER (PARTITION BY term), 6) AS posterior FROM e""")
def m14(spark, d):
    s = X.distant_setup(spark, d)
    classes, model = X.fit_distant_nb(s)
    return rounded(M.term_posteriors(classes, model, s.vocab))


@query("m03_m04_rbf_svm_rff", None)
def m03(spark, d):
    """Rows-only: an approximation of the kernel SVM has no exact SQL twin."""
    from ..operators.svm import fit_predict_rff_svm
    tr, te = _emb_split(spark, d)
    return fit_predict_rff_svm(tr, te, "vec", C=2.0, n_features=256, seed=0)
