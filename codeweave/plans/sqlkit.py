"""SQL fragments for DuckDB oracles (mirrors of the Column builders)."""
from __future__ import annotations

from ..functions.hashing import sql_hash  # noqa: F401
from ..functions.stopwords import sql_list, stopword_list

TOKENS = r"[\p{L}\p{N}_]{2,}"


def stop_sql(sets: str = "ce") -> str:
    return sql_list(stopword_list(sets))


def terms_cte(src: str, id_col: str, text_col: str, sets: str = "ce", name: str = "cnt") -> str:
    """CTEs ``{name}_tok`` and ``{name}`` (id, term, tf): tokens minus stopwords,
    plus adjacent bigrams, counted per id."""
    st = stop_sql(sets) if sets else "[]"
    return f"""{name}_tok AS (
  SELECT {id_col} AS id,
         list_filter(regexp_extract_all(lower({text_col}), '{TOKENS}'), lambda x: NOT list_contains({st}, x)) AS t
  FROM {src}),
{name} AS (
  SELECT id, term, count(*) AS tf FROM (
    SELECT id, unnest(t) AS term FROM {name}_tok
    UNION ALL
    SELECT id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM {name}_tok)
  GROUP BY id, term)"""


def tfidf_ctes(counts: str, prefix: str = "v", k: int = 5000, n: str | None = None) -> str:
    """Vocabulary ``{prefix}_vocab(term,total,df,idf)`` fitted on ``counts``; ``n`` is the
    SELECT that counts the fit corpus' documents."""
    return f"""{prefix}_n AS ({n or f'SELECT count(DISTINCT id) AS n FROM {counts}'}),
{prefix}_top AS (
  SELECT term, sum(tf) AS total, count(*) AS df FROM {counts}
  GROUP BY term ORDER BY total DESC, term LIMIT {k}),
{prefix}_vocab AS (
  SELECT term, total, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM {prefix}_top, {prefix}_n)"""


def weights_cte(name: str, counts: str, vocab: str) -> str:
    return f"""{name}_raw AS (SELECT id, term, tf * idf AS w FROM {counts} JOIN {vocab} USING (term)),
{name} AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {name}_raw)"""


def group_split_cte(name: str, src: str, group: str, key: str, frac: float, seed) -> str:
    h = sql_hash(seed, key)
    return f"""{name}_h AS (SELECT *, {h} AS _h FROM {src}),
{name} AS (
  SELECT * EXCLUDE (_h, rn, grp_n), rn <= ceil(grp_n * {frac}) AS is_test FROM (
    SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY _h, {key}) AS rn,
           count(*) OVER (PARTITION BY {group}) AS grp_n FROM {name}_h))"""


def nb_ctes(train_w: str, train_y: str, vocab: str, alpha: float = 0.001, prefix: str = "nb") -> str:
    """Multinomial NB fit: ``{prefix}_cls(label, base)``, ``{prefix}_model(label, term, delta)``."""
    return f"""{prefix}_nct AS (
  SELECT y.label, w.term, sum(w.w) AS n_ct FROM {train_w} w JOIN {train_y} y USING (id) GROUP BY y.label, w.term),
{prefix}_nc AS (SELECT label, sum(n_ct) AS n_c FROM {prefix}_nct GROUP BY label),
{prefix}_V AS (SELECT count(*) AS v FROM {vocab}),
{prefix}_cls AS (SELECT label, ln({alpha} / (n_c + {alpha} * v)) AS base FROM {prefix}_nc, {prefix}_V),
{prefix}_model AS (
  SELECT label, term, ln((n_ct + {alpha}) / (n_c + {alpha} * v)) - ln({alpha} / (n_c + {alpha} * v)) AS delta
  FROM {prefix}_nct JOIN {prefix}_nc USING (label), {prefix}_V)"""


def nb_score_ctes(ids: str, test_w: str, prefix: str = "nb", out: str = "scores") -> str:
    """Scores (id, label, jll, score) for every id in ``ids`` over the class table."""
    return f"""{out}_ws AS (SELECT id, sum(w) AS wsum FROM {test_w} GROUP BY id),
{out}_part AS (SELECT id, label, sum(w * delta) AS s FROM {test_w} JOIN {prefix}_model USING (term) GROUP BY id, label),
{out}_jll AS (
  SELECT t.id, c.label, coalesce(ws.wsum, 0) * c.base + coalesce(p.s, 0) AS jll
  FROM (SELECT DISTINCT id FROM {ids}) t CROSS JOIN {prefix}_cls c
  LEFT JOIN {out}_ws ws ON ws.id = t.id
  LEFT JOIN {out}_part p ON p.id = t.id AND p.label = c.label),
{out}_e AS (SELECT id, label, jll, exp(jll - max(jll) OVER (PARTITION BY id)) AS e FROM {out}_jll),
{out} AS (SELECT id, label, jll, e / sum(e) OVER (PARTITION BY id) AS score FROM {out}_e)"""


def prf_ctes(gold: str, pred: str, out: str = "pc") -> str:
    """Per-class counts and P/R/F1 (classes with gold only)."""
    return f"""{out}_cells AS (
  SELECT id, label, max(g) AS g, max(p) AS p FROM (
    SELECT id, label, 1 AS g, 0 AS p FROM {gold}
    UNION ALL SELECT id, label, 0 AS g, 1 AS p FROM {pred}) GROUP BY id, label),
{out}_cnt AS (
  SELECT label, CAST(sum(g * p) AS BIGINT) AS tp, CAST(sum((1 - g) * p) AS BIGINT) AS fp,
         CAST(sum(g * (1 - p)) AS BIGINT) AS fn FROM {out}_cells GROUP BY label),
{out} AS (
  SELECT label, tp, fp, fn, tp + fn AS support,
         coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
         coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1
  FROM {out}_cnt WHERE tp + fn > 0)"""


def method_ctes(method: str, tx: str, x: str) -> str:
    """``ms(id, label, pred, score)``: every document of ``tids`` with every class of ``ty``, by a classifier of
    operators.keyed fitted on ``tx`` (id, term, w) and ``ty`` (id, label), applied to ``x``. Naive Bayes
    fragments (``nb_ctes``, ``nb_score_ctes``) must be there."""
    if method == "mnb":
        return "ms AS (SELECT id, label, score > 0.1 AS pred, score FROM scores)"
    if method == "bnb":
        return f"""bn_n AS (SELECT count(DISTINCT id) AS n FROM ty),
bn_tt AS (SELECT term, sum(w) AS T_t FROM {tx} GROUP BY term),
bn_T AS (SELECT sum(T_t) AS T FROM bn_tt),
bn_nct AS (SELECT y.label, w.term, sum(w.w) AS n_ct FROM {tx} w JOIN ty y USING (id) GROUP BY y.label, w.term),
bn_nc AS (SELECT label, sum(n_ct) AS n_c FROM bn_nct GROUP BY label),
bn_np AS (SELECT label, count(*) AS n_pos FROM ty GROUP BY label),
bn_cls AS (SELECT p.label, ln(0.001) - ln(coalesce(n_c, 0) + 0.001 * v) AS kpos, -ln(T - coalesce(n_c, 0) + 0.001 * v) AS kneg,
  ln(n_pos / n) AS ppos, ln((n - n_pos) / n) AS pneg FROM bn_np p LEFT JOIN bn_nc USING (label), bn_n, bn_T, nb_V),
bn_model AS (SELECT label, term, ln(n_ct + 0.001) - ln(0.001) AS dpos, ln(T_t - n_ct + 0.001) - ln(T_t + 0.001) AS dneg
  FROM bn_nct JOIN bn_tt USING (term)),
bn_lt AS (SELECT term, ln(coalesce(T_t, 0) + 0.001) AS lt FROM v_vocab LEFT JOIN bn_tt USING (term)),
bn_part AS (SELECT id, label, sum(w * dpos) AS sp, sum(w * dneg) AS sn FROM {x} JOIN bn_model USING (term) GROUP BY id, label),
bn_doc AS (SELECT id, sum(w) AS W, sum(w * lt) AS A FROM {x} JOIN bn_lt USING (term) GROUP BY id),
bn_j AS (SELECT t.id, c.label, coalesce(W, 0) * kpos + coalesce(sp, 0) + ppos AS jp, coalesce(A, 0) + coalesce(W, 0) * kneg + coalesce(sn, 0) + pneg AS jn
  FROM (SELECT DISTINCT id FROM tids) t CROSS JOIN bn_cls c LEFT JOIN bn_doc d ON d.id = t.id LEFT JOIN bn_part p ON p.id = t.id AND p.label = c.label),
ms AS (SELECT id, label, 1 / (1 + exp(jn - jp)) > 0.1 AS pred, 1 / (1 + exp(jn - jp)) AS score FROM bn_j)"""
    if method == "centroid":
        return f"""ce_nd AS (SELECT label, count(*) AS nd FROM ty GROUP BY label),
ce_c AS (SELECT label, term, sum(w) / any_value(nd) AS c FROM {tx} JOIN ty USING (id) JOIN ce_nd USING (label) GROUP BY label, term),
ce_n AS (SELECT label, sum(c * c) AS cc FROM ce_c GROUP BY label),
ce_d AS (SELECT a.id, label, sum(a.w * c) AS dot FROM {x} a JOIN ce_c USING (term) GROUP BY a.id, label),
ce_x AS (SELECT id, sum(w * w) AS xx FROM {x} GROUP BY id),
ce_dd AS (SELECT t.id, n.label, round(coalesce(xx, 0) - 2 * coalesce(dot, 0) + cc, 9) AS d2 FROM (SELECT DISTINCT id FROM tids) t CROSS JOIN ce_n n
  LEFT JOIN ce_x ON ce_x.id = t.id LEFT JOIN ce_d ON ce_d.id = t.id AND ce_d.label = n.label),
ce_b AS (SELECT id, arg_min(label, (d2, label)) AS best FROM ce_dd GROUP BY id),
ms AS (SELECT id, label, label = best AS pred, CASE WHEN label = best THEN 1.0 ELSE 0.0 END AS score FROM ce_dd JOIN ce_b USING (id))"""
    return f"""kn_y AS (SELECT id, min(label) AS label FROM ty GROUP BY id),
kn_dot AS (SELECT a.id AS qid, b.id AS rid, sum(a.w * b.w) AS dot FROM {x} a JOIN {tx} b USING (term) GROUP BY a.id, b.id),
kn_p AS (SELECT q.id AS qid, t.id AS rid, t.label, greatest(round(1 - coalesce(dot, 0), 9), 0) AS dist
  FROM (SELECT DISTINCT id FROM tids) q CROSS JOIN kn_y t LEFT JOIN kn_dot d ON d.qid = q.id AND d.rid = t.id),
kn_t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS r FROM kn_p) WHERE r <= 3),
kn_w AS (SELECT qid, label, sum(CASE WHEN dist <= 0 THEN 1.0 ELSE 0.0 END) AS hits, sum(CASE WHEN dist > 0 THEN 1.0 / dist ELSE 0.0 END) AS inv,
  max(max(CASE WHEN dist <= 0 THEN 1 ELSE 0 END)) OVER (PARTITION BY qid) AS ex FROM kn_t GROUP BY qid, label),
kn_s AS (SELECT qid, label, CASE WHEN ex = 1 THEN hits ELSE inv END AS wt FROM kn_w),
kn_r AS (SELECT qid, label, round(wt / sum(wt) OVER (PARTITION BY qid), 9) AS score FROM kn_s),
kn_b AS (SELECT qid, arg_min(label, (-score, label)) AS best FROM kn_r WHERE score > 0 GROUP BY qid),
kn_all AS (SELECT q.id, l.label FROM (SELECT DISTINCT id FROM tids) q CROSS JOIN (SELECT DISTINCT label FROM kn_y) l),
ms AS (SELECT a.id, a.label, a.label = b.best AS pred, coalesce(r.score, 0.0) AS score FROM kn_all a
  JOIN kn_b b ON b.qid = a.id LEFT JOIN kn_r r ON r.qid = a.id AND r.label = a.label)"""
