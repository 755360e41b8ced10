"""Registered queries: sampling/splits X02-X11 and evaluation E03-E15."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import stable_hash
from ..operators import evaluate as E
from ..operators import sample as S
from ..operators.scan import running, written
from ..functions.hashing import SQL_SPAN
from ..session import bounded_rows
from ..sources.tables import table
from . import experiments as X
from .q_core import DISTANT_SQL
from .registry import query, rounded
from .sqlkit import prf_ctes, sql_hash

X02_SEED, X03_SEED, X04_SEED, X05_SEED, X06_SEED, X07_SEED, X08_SEED = 23490, 5, 3, 17, 29, 31, 37


def _events_labels(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("label"))


# ---- X02: ranks, strata, carry, split (DuckDB twin of the closed form)
X02_SQL = f"""WITH dl AS (SELECT DISTINCT user_id AS id, event_type AS label FROM events),
sz AS (SELECT label, count(*) AS size FROM dl GROUP BY label),
rk AS (SELECT label, row_number() OVER (ORDER BY size, label) AS crank FROM sz),
st AS (SELECT id, arg_min(label, crank) AS own FROM dl JOIN rk USING (label) GROUP BY id),
ss0 AS (SELECT own, count(*) AS n, any_value(crank) AS crank FROM st JOIN rk ON rk.label = st.own GROUP BY own),
ss1 AS (SELECT *, CASE WHEN n = 1 THEN 1 ELSE 0 END AS single FROM ss0),
ss2 AS (SELECT *, sum(1 - single) OVER (ORDER BY crank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
               lead(own) OVER (ORDER BY crank) AS nxt FROM ss1),
ss3 AS (SELECT *, row_number() OVER (PARTITION BY run, single ORDER BY crank) AS pos FROM ss2),
ss AS (SELECT own, CASE WHEN single = 1 AND pos % 2 = 1 AND nxt IS NOT NULL THEN nxt ELSE own END AS stratum FROM ss3),
s AS (SELECT id, stratum FROM st JOIN ss USING (own)),
h AS (SELECT id, stratum, {sql_hash(X02_SEED, 'stratum', 'id')} AS h FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, id) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM h)
SELECT id, stratum, n >= 2 AND rn <= ceil(n * 0.2) AS is_test FROM r"""


@query("x02_multilabel_split", X02_SQL)
def x02(spark, d):
    return S.multilabel_split(_events_labels(spark, d), X02_SEED, 0.2)


@query("x03_pair_split", f"""WITH p AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS code FROM orders),
x AS (SELECT split, id, code FROM p, (SELECT unnest(range(3)) AS split)),
h AS (SELECT *, {sql_hash(X03_SEED, 'split', 'id', 'code')} AS h FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY split, code ORDER BY h, id) AS rn,
             count(*) OVER (PARTITION BY split, code) AS n FROM h)
SELECT CAST(split AS INTEGER) AS split, id, code, rn <= ceil(n * 0.2) AS is_test FROM r""")
def x03(spark, d):
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("code")).distinct()
    return S.pair_split(p, 3, X03_SEED, 0.2)


@query("x04_stratified_folds", f"""WITH h AS (SELECT doc_id AS id, lang AS label, {sql_hash(X04_SEED, 'doc_id')} AS h FROM documents)
SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY h, id) - 1) % 5 AS INTEGER) AS fold FROM h""")
def x04(spark, d):
    dl = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    return S.stratified_folds(dl, 5, X04_SEED)


X05_SQL = f"""WITH it AS (SELECT doc_id AS item_id, lang AS label FROM documents),
h AS (SELECT *, {sql_hash(X05_SEED, 'label', 'item_id')} AS h FROM it),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, item_id) AS rn FROM h),
blocks AS (SELECT label, count(*) AS size FROM it GROUP BY label),
b2 AS (SELECT label, size, coalesce(sum(size) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS off FROM blocks),
idx AS (SELECT item_id, off + rn - 1 AS g FROM r JOIN b2 USING (label)),
ex AS (SELECT label, label AS excluded FROM blocks UNION SELECT * FROM
  (SELECT label, lead(label) OVER (ORDER BY label) AS excluded FROM blocks) WHERE excluded IS NOT NULL),
eb AS (SELECT ex.label, b2.size, b2.off FROM ex JOIN b2 ON b2.label = ex.excluded),
eb2 AS (SELECT label, size, off - coalesce(sum(size) OVER (PARTITION BY label ORDER BY off
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM eb),
per AS (SELECT label, (SELECT sum(size) FROM blocks) - sum(size) AS pool FROM eb2 GROUP BY label),
dr AS (SELECT it.label, it.item_id AS pos_item, {sql_hash(X05_SEED, "'neg'", 'it.label', 'it.item_id')} % per.pool AS u
  FROM it JOIN per USING (label) WHERE per.pool > 0),
dg AS (SELECT dr.label, dr.pos_item, u + coalesce(sum(CASE WHEN eb2.p <= u THEN eb2.size ELSE 0 END), 0) AS g
  FROM dr JOIN eb2 USING (label) GROUP BY dr.label, dr.pos_item, u)"""


@query("x05_balanced_negatives", X05_SQL + """
SELECT label, item_id, 1 AS polarity FROM it
UNION ALL SELECT dg.label, idx.item_id, 0 FROM dg JOIN idx USING (g)""")
def x05(spark, d):
    it = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("label"))
    # every label also excludes its successor, so that pools differ
    names = it.select("label").distinct()
    later = names.select(F.col("label").alias("other"))
    ex = names.join(later, F.col("other") > F.col("label")).groupBy("label").agg(F.min("other").alias("excluded"))
    pairs, _ = S.balanced_negatives(it, ex, X05_SEED)
    return pairs


@query("x09_training_pairs", X05_SQL + """
SELECT label, item_id, 'This is a problem of ' || label || '.' AS prompt, 1 AS polarity FROM it
UNION ALL SELECT dg.label, idx.item_id, 'This is a problem of ' || dg.label || '.', 0 FROM dg JOIN idx USING (g)""")
def x09(spark, d):
    pairs = x05(spark, d)
    return pairs.select("label", "item_id", F.concat(F.lit("This is a problem of "), "label", F.lit(".")).alias("prompt"),
                        "polarity")


@query("x06_bootstrap_counts", f"""WITH t AS (SELECT doc_id FROM documents),
n AS (SELECT count(*) AS n FROM t),
d AS (SELECT rep, j FROM (SELECT unnest(range(1000)) AS rep), (SELECT unnest(range(n)) AS j FROM n)),
x AS (SELECT rep, {sql_hash(X06_SEED, 'rep', 'j')} % (SELECT n FROM n) AS idx FROM d)
SELECT rep, idx, count(*) AS w FROM x GROUP BY rep, idx""")
def x06(spark, d):
    n = table(spark, d, "documents").count()
    return E.bootstrap_draws(spark, n, 1000, X06_SEED)


@query("x07_random_label_counts", f"""WITH l AS (SELECT DISTINCT lang AS label FROM documents),
x AS (SELECT rep, doc_id AS id, label FROM documents, l, (SELECT unnest(range(1000)) AS rep))
SELECT rep, label, CAST(sum({sql_hash(X07_SEED, 'rep', 'id', 'label')} % 2) AS BIGINT) AS ones FROM x GROUP BY rep, label""")
def x07(spark, d):
    docs = table(spark, d, "documents")
    labels = [r["lang"] for r in bounded_rows(docs.select("lang").distinct().orderBy("lang"), 100_000, "labels")]
    m = S.random_labels(docs.select(F.col("doc_id").alias("id")), labels, 1000, X07_SEED)
    return m.groupBy("rep", "label").agg(F.sum("flag").cast("bigint").alias("ones"))


@query("x08_masked_tokens", f"""WITH tk AS (SELECT doc_id AS id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM documents)),
tt AS (SELECT id, pos, token, token = 'the' AS is_target FROM tk),
voc AS (SELECT term, row_number() OVER (ORDER BY total DESC, term) + 1 AS token_id FROM (
  SELECT token AS term, count(*) AS total FROM tk GROUP BY token)),
vs AS (SELECT count(*) + 2 AS v FROM voc),
j AS (SELECT tt.*, coalesce(voc.token_id, 0) AS tid, {sql_hash(X08_SEED, 'tt.id', 'tt.pos')} / {SQL_SPAN} AS r,
        {sql_hash(X08_SEED, "'rand'", 'tt.id', 'tt.pos')} % ((SELECT v FROM vs) - 1) + 1 AS rnd
  FROM tt LEFT JOIN voc ON voc.term = tt.token),
m AS (SELECT id, pos, CASE WHEN is_target OR r < 0.12 THEN 1 WHEN r < 0.135 THEN tid WHEN r < 0.15 THEN rnd ELSE tid END AS input_id,
        CASE WHEN is_target OR r < 0.15 THEN tid ELSE -100 END AS target FROM j)
SELECT id, count(*) AS n, CAST(sum(CASE WHEN input_id = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_mask,
  CAST(sum(CASE WHEN target <> -100 THEN 1 ELSE 0 END) AS BIGINT) AS n_target,
  CAST(sum(input_id * (pos + 1)) AS BIGINT) AS in_sum, CAST(sum(target * (pos + 1)) AS BIGINT) AS tg_sum FROM m GROUP BY id""")
def x08(spark, d):
    docs = table(spark, d, "documents")
    tk = docs.select(F.col("doc_id").alias("id"),
                     F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)).alias("pos", "token"))
    tk = tk.withColumn("is_target", F.col("token") == "the")
    top = tk.groupBy(F.col("token").alias("term")).agg(F.count(F.lit(1)).alias("total"))
    # token ids in order of totals: ranges of (total, term), their sizes summed, numbered inside; no task sorts all terms
    top = top.withColumn("often", -F.col("total"))
    voc = running(top, [], ["often", "term"], {"nth": F.lit(1).cast("long")}).select("term", (F.col("nth") + 1).alias("token_id"))
    m = S.mask_tokens(tk, voc, X08_SEED)
    return m.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("input_id") == 1).cast("int")).cast("bigint").alias("n_mask"),
        F.sum((F.col("target") != -100).cast("int")).cast("bigint").alias("n_target"),
        F.sum(F.col("input_id") * (F.col("pos") + 1)).cast("bigint").alias("in_sum"),
        F.sum(F.col("target") * (F.col("pos") + 1)).cast("bigint").alias("tg_sum"))


@query("x10_train_dev_selection", "SELECT doc_id AS id, true AS in_train, true AS in_dev FROM documents")
def x10(spark, d):
    from ..operators.sample import train_dev
    return train_dev(table(spark, d, "documents").select(F.col("doc_id").alias("id")))


@query("x11_prediction_rows", """SELECT item_id AS id, 0 AS chunk_id, text, 'This is a problem of [MASK].' AS prompt
FROM benchmark""")
def x11(spark, d):
    from ..operators.sample import prediction_rows
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.array("text").alias("chunks"))
    return prediction_rows(b, "This is a problem of {}.")


# ------------------------------------------------------------------ evaluation
PRED_SQL = f"""{DISTANT_SQL},
pred AS (SELECT id, label FROM scores WHERE score > 0.1),
{prf_ctes('tids', 'pred')}"""


def _flag(spark, d):
    s = X.distant_setup(spark, d)
    return s, X.distant_nb(s)


@query("e03_report", f"""WITH {PRED_SQL},
kept AS (SELECT label FROM pc),
cells AS (SELECT id, label, max(g) AS g, max(p) AS p FROM (
  SELECT id, label, 1 AS g, 0 AS p FROM tids WHERE label IN (SELECT label FROM kept)
  UNION ALL SELECT id, label, 0, 1 FROM pred WHERE label IN (SELECT label FROM kept)) GROUP BY id, label),
dd AS (SELECT t.id, coalesce(sum(g * p), 0) AS tp, coalesce(sum(g), 0) AS ng, coalesce(sum(p), 0) AS np
  FROM (SELECT DISTINCT id FROM tids) t LEFT JOIN cells c USING (id) GROUP BY t.id)
SELECT 'micro' AS average, round(coalesce(sum(tp) / nullif(sum(tp + fp), 0), 0), 6) AS precision,
  round(coalesce(sum(tp) / nullif(sum(tp + fn), 0), 0), 6) AS recall,
  round(coalesce(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 0), 6) AS f1 FROM pc
UNION ALL SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM pc
UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6) FROM pc
UNION ALL SELECT 'samples', round(avg(coalesce(tp / nullif(np, 0), 0)), 6), round(avg(coalesce(tp / nullif(ng, 0), 0)), 6),
  round(avg(coalesce(2 * tp / nullif(ng + np, 0), 0)), 6) FROM dd""")
def e03(spark, d):
    s, p = _flag(spark, d)
    return rounded(E.report(s.gold, p, s.test_ids))


AUC_SQL = """a0 AS (SELECT s.label, round(s.score, 10) AS score, CASE WHEN g.id IS NOT NULL THEN 1 ELSE 0 END AS y
  FROM scores s LEFT JOIN tids g ON g.id = s.id AND g.label = s.label),
a1 AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY score)
  + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0 AS r FROM a0),
a2 AS (SELECT label, sum(y) AS n_pos, count(*) - sum(y) AS n_neg, sum(y * r) AS rs FROM a1 GROUP BY label),
auc AS (SELECT label, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg,
  CASE WHEN n_neg > 0 THEN (rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) END AS auc FROM a2 WHERE n_pos > 0)"""


def _auc(spark, d):
    s = X.distant_setup(spark, d)
    sc = X.distant_nb(s).select("id", "label", F.round("score", 10).alias("score"))
    return E.roc_auc(s.gold, sc, s.test_ids)


@query("e04_roc_auc", f"""WITH {PRED_SQL}, {AUC_SQL}
SELECT label, n_pos, n_neg, round(auc, 6) AS auc FROM auc""")
def e04(spark, d):
    return rounded(_auc(spark, d))


@query("e04_macro_auc", f"""WITH {PRED_SQL}, {AUC_SQL}
SELECT round(avg(auc), 6) AS auc FROM auc WHERE auc IS NOT NULL""")
def e04m(spark, d):
    return rounded(E.macro_auc(_auc(spark, d)))


@query("e05_macro_without_class", f"""WITH {PRED_SQL}
SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1
FROM pc WHERE label <> 'en'""")
def e05(spark, d):
    s, p = _flag(spark, d)
    return rounded(E.macro(E.per_class(s.gold, p).filter(F.col("label") != "en")))


CONF_SQL = """cf AS (SELECT g.gold, p.pred, count(*) AS n FROM (SELECT DISTINCT id FROM tids) t
  LEFT JOIN (SELECT id, min(label) AS gold FROM tids GROUP BY id) g USING (id)
  LEFT JOIN (SELECT id, min(label) AS pred FROM pred GROUP BY id) p USING (id) GROUP BY g.gold, p.pred)"""


@query("e06_confusion_first_label", f"""WITH {PRED_SQL}, {CONF_SQL} SELECT gold, pred, n FROM cf""")
def e06(spark, d):
    s, p = _flag(spark, d)
    return E.first_label_confusion(s.gold, p, s.test_ids)


@query("e07_binary_confusion", f"""WITH {PRED_SQL}
SELECT label, (SELECT count(DISTINCT id) FROM tids) - tp - fp - fn AS tn, fp, fn, tp FROM pc_cnt""")
def e07(spark, d):
    s, p = _flag(spark, d)
    return E.binary_confusion(s.gold, p, s.test_ids.count())


@query("e08_specificity", f"""WITH {PRED_SQL}, {CONF_SQL},
labs AS (SELECT DISTINCT gold AS label FROM cf WHERE gold IS NOT NULL)
SELECT label, round(sum(CASE WHEN pred IS NULL OR pred <> label THEN n ELSE 0 END) / sum(n), 6) AS specificity
FROM labs JOIN cf ON cf.gold IS NULL OR cf.gold <> labs.label GROUP BY label""")
def e08(spark, d):
    s, p = _flag(spark, d)
    return rounded(E.specificity(E.first_label_confusion(s.gold, p, s.test_ids)))


@query("e09_recall_all_classes", f"""WITH {PRED_SQL}
SELECT label, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM pc_cnt""")
def e09(spark, d):
    s, p = _flag(spark, d)
    return rounded(E.prf(E.confusion_counts(s.gold, p.filter("pred")), keep_no_gold=True).select("label", "recall"))


@query("e10_majority_baseline", """WITH f AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang),
m AS (SELECT label, n / (SELECT count(*) FROM documents) AS share FROM f ORDER BY n DESC, label LIMIT 1)
SELECT label, round(share, 6) AS precision, 1.0 AS recall,
  round(2 * share / (1 + share) / (SELECT count(*) FROM f), 6) AS f1_macro FROM m""")
def e10(spark, d):
    dl = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    return rounded(E.majority_baseline(dl))


@query("e11_random_baseline", f"""WITH l AS (SELECT DISTINCT lang AS label FROM documents),
x AS (SELECT rep, doc_id AS id, label FROM documents, l, (SELECT unnest(range(1000)) AS rep)),
rp AS (SELECT rep, id, label FROM x WHERE {sql_hash(X07_SEED, 'rep', 'id', 'label')} % 2 = 1),
gd AS (SELECT rep, doc_id AS id, lang AS label FROM documents, (SELECT unnest(range(1000)) AS rep)),
cells AS (SELECT rep, id, label, max(g) AS g, max(p) AS p FROM (SELECT rep, id, label, 1 AS g, 0 AS p FROM gd
  UNION ALL SELECT rep, id, label, 0, 1 FROM rp) GROUP BY rep, id, label),
cnt AS (SELECT rep, label, sum(g * p) AS tp, sum((1 - g) * p) AS fp, sum(g * (1 - p)) AS fn FROM cells GROUP BY rep, label),
pr AS (SELECT rep, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM cnt WHERE tp + fn > 0),
m AS (SELECT rep, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM pr GROUP BY rep)
SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM m""")
def e11(spark, d):
    docs = table(spark, d, "documents")
    labels = [r["lang"] for r in bounded_rows(docs.select("lang").distinct().orderBy("lang"), 100_000, "labels")]
    # a document's gold labels stay in its row (a struct tells a null label from none), so no replicate is shuffled
    gold = docs.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct(F.col("lang").alias("label"))).alias("gold"))
    g = F.exists("gold", lambda x: x["label"].eqNullSafe(F.col("label"))).cast("int")
    rnd = S.random_labels(gold, labels, 1000, X07_SEED, {"g": g})
    per = E.per_rep_macro(rnd.select("rep", "label", "g", F.col("flag").alias("p")))
    return rounded(per.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")))


BOOT_B = 1000
BOOT_SQL = f"""ix AS (SELECT id, row_number() OVER (ORDER BY {sql_hash(29, 'id')}, id) - 1 AS idx FROM (SELECT DISTINCT id FROM tids)),
nn AS (SELECT count(*) AS n FROM ix),
bd AS (SELECT rep, {sql_hash(X06_SEED, 'rep', 'j')} % (SELECT n FROM nn) AS idx
  FROM (SELECT unnest(range({BOOT_B})) AS rep), (SELECT unnest(range(n)) AS j FROM nn)),
bw AS (SELECT rep, idx, count(*) AS w FROM bd GROUP BY rep, idx),
cells AS (SELECT idx, label, max(g) AS g, max(p) AS p FROM (SELECT id, label, 1 AS g, 0 AS p FROM tids
  UNION ALL SELECT id, label, 0, 1 FROM pred) JOIN ix USING (id) GROUP BY idx, label),
bc AS (SELECT rep, label, sum(w * g * p) AS tp, sum(w * (1 - g) * p) AS fp, sum(w * g * (1 - p)) AS fn
  FROM cells JOIN bw USING (idx) GROUP BY rep, label),
bp AS (SELECT rep, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM bc WHERE tp + fn > 0),
bm AS (SELECT rep, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM bp GROUP BY rep)"""


def _boot(s, pred, b=BOOT_B):
    cells = E.doc_cells(s.gold, pred, s.test_ids)
    n = s.test_ids.count()
    return E.macro(E.prf(E.bootstrap_sums(cells, n, b, X06_SEED)), "rep")


@query("e12_bootstrap_ci", f"""WITH {PRED_SQL}, {BOOT_SQL}
SELECT 'precision' AS metric, round(quantile_cont(precision, 0.05), 6) AS lo, round(quantile_cont(precision, 0.95), 6) AS hi FROM bm
UNION ALL SELECT 'recall', round(quantile_cont(recall, 0.05), 6), round(quantile_cont(recall, 0.95), 6) FROM bm
UNION ALL SELECT 'f1', round(quantile_cont(f1, 0.05), 6), round(quantile_cont(f1, 0.95), 6) FROM bm""")
def e12(spark, d):
    s, p = _flag(spark, d)
    return rounded(E.confidence_interval(_boot(s, p)))


@query("e12_bootstrap_ci_outcomes")
def e12_outcomes(spark, d):
    """Rows-only: the same law by splitting over distinct outcomes (tests hold it against the multinomial)."""
    s, p = _flag(spark, d)
    return rounded(E.confidence_interval(E.bootstrap_metrics(s.gold, p, s.test_ids, BOOT_B, X06_SEED)))


@query("e13_paired_bootstrap_pvalue", f"""WITH {PRED_SQL}, {BOOT_SQL},
pred2 AS (SELECT id, label FROM scores WHERE score > 0.5),
cells2 AS (SELECT idx, label, max(g) AS g, max(p) AS p FROM (SELECT id, label, 1 AS g, 0 AS p FROM tids
  UNION ALL SELECT id, label, 0, 1 FROM pred2) JOIN ix USING (id) GROUP BY idx, label),
bc2 AS (SELECT rep, label, sum(w * g * p) AS tp, sum(w * (1 - g) * p) AS fp, sum(w * g * (1 - p)) AS fn
  FROM cells2 JOIN bw USING (idx) GROUP BY rep, label),
bm2 AS (SELECT rep, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS f1 FROM bc2 WHERE tp + fn > 0 GROUP BY rep),
c2 AS (SELECT label, sum(g * p) AS tp, sum((1 - g) * p) AS fp, sum(g * (1 - p)) AS fn FROM cells2 GROUP BY label),
obs AS (SELECT (SELECT avg(f1) FROM pc) - (SELECT avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) FROM c2
  WHERE tp + fn > 0) AS diff)
SELECT round((SELECT diff FROM obs), 6) AS observed_diff,
  round(avg(CASE WHEN a.f1 - b.f1 > 2 * (SELECT diff FROM obs) THEN 1.0 ELSE 0.0 END), 6) AS p_value
FROM bm a JOIN bm2 b USING (rep)""")
def e13(spark, d):
    s, p = _flag(spark, d)
    p = written(p, "predictions")  # texts are scored once for both models
    p2 = p.withColumn("pred", F.col("score") > 0.5)
    cells = [E.doc_cells(s.gold, x, s.test_ids).withColumn("model", F.lit(m)) for m, x in (("a", p), ("b", p2))]
    sums = E.bootstrap_sums(cells[0].unionByName(cells[1]), s.test_ids.count(), BOOT_B, X06_SEED, "model")
    f1 = {m: F.max(F.when(F.col("model") == m, F.col("f1"))).alias(f"f{m}") for m in "ab"}
    fa = E.evaluate(s.gold, p).first()["f1"]
    fb = E.evaluate(s.gold, p2).first()["f1"]
    diff = fa - fb
    j = E.macro(E.prf(sums), "rep", "model").groupBy("rep").agg(*f1.values()).filter("fa is not null and fb is not null")
    return rounded(j.agg(F.lit(diff).alias("observed_diff"),
                         F.avg(((F.col("fa") - F.col("fb")) > 2 * diff).cast("double")).alias("p_value")))


@query("e14_overfit_check", f"""WITH {DISTANT_SQL},
{__import__('codeweave.plans.sqlkit', fromlist=['x']).nb_score_ctes('ty', 'dw', 'nb', 'ts')},
pred AS (SELECT id, label FROM ts WHERE score > 0.1),
{prf_ctes('ty', 'pred', 'tpc')}
SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM tpc""")
def e14(spark, d):
    from ..operators import classify as M
    s = X.distant_setup(spark, d)
    classes, model = X.fit_distant_nb(s)
    ids = s.desc_w.select("id").distinct()
    p = M.threshold(M.score_linear_sparse(ids, s.desc_w, classes, model), 0.1)
    return rounded(E.evaluate(ids.withColumn("label", F.col("id")), p))


@query("e15_masked_accuracy", """WITH e AS (SELECT vec_id, label, embedding AS l FROM embeddings)
SELECT round(avg(CASE WHEN list_position(l, list_max(l)) - 1 = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM e WHERE label <> 9""")
def e15(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("embedding").alias("l"))
    rows = e.select((F.array_position("l", F.array_max("l")) - 1).alias("pred"),
                    F.when(F.col("label") == 9, F.lit(-100)).otherwise(F.col("label")).alias("target"))
    return rounded(E.masked_accuracy(rows))


def _poisson_sql(u: str) -> str:
    import math
    cdf, acc = [], 0.0
    for k in range(13):
        acc += math.exp(-1.0) / math.factorial(k)
        cdf.append(acc)
    return "CASE " + " ".join(f"WHEN {u} < {cdf[k]!r} THEN {k}" for k in range(12)) + " ELSE 12 END"


@query("x06_poisson_bootstrap_ci", f"""WITH {PRED_SQL},
cells AS (SELECT id, label, max(g) AS g, max(p) AS p FROM (SELECT id, label, 1 AS g, 0 AS p FROM tids
  UNION ALL SELECT id, label, 0, 1 FROM pred) GROUP BY id, label),
x AS (SELECT cells.*, rep, {_poisson_sql(sql_hash(X06_SEED, 'rep', 'id') + ' / ' + SQL_SPAN)} AS w
  FROM cells, (SELECT unnest(range({BOOT_B})) AS rep)),
bc AS (SELECT rep, label, sum(w * g * p) AS tp, sum(w * (1 - g) * p) AS fp, sum(w * g * (1 - p)) AS fn FROM x GROUP BY rep, label),
bp AS (SELECT rep, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM bc WHERE tp + fn > 0),
bm AS (SELECT rep, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM bp GROUP BY rep)
SELECT 'precision' AS metric, round(quantile_cont(precision, 0.05), 6) AS lo, round(quantile_cont(precision, 0.95), 6) AS hi FROM bm
UNION ALL SELECT 'recall', round(quantile_cont(recall, 0.05), 6), round(quantile_cont(recall, 0.95), 6) FROM bm
UNION ALL SELECT 'f1', round(quantile_cont(f1, 0.05), 6), round(quantile_cont(f1, 0.95), 6) FROM bm""")
def x06p(spark, d):
    s, p = _flag(spark, d)
    g = s.gold.select("id", "label", F.lit(1).alias("g"), F.lit(0).alias("p"))
    pr = p.filter("pred").select("id", "label", F.lit(0).alias("g"), F.lit(1).alias("p"))
    cells = g.unionByName(pr).groupBy("id", "label").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    bc = E.poisson_bootstrap_cells(cells, BOOT_B, X06_SEED)
    return rounded(E.confidence_interval(E.macro(E.prf(bc), "rep")))
