"""Registered queries: experiment flows R02-R11 and the remaining relation /
export operators that compose them (J08, J12-J14, A13, S21)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import classify as M
from ..operators import evaluate as E
from ..operators import relate as J
from ..operators.sample import multilabel_split
from ..operators.scan import written
from ..operators.structure import nonempty_lines
from ..session import bounded_rows
from ..sources import io as S
from ..sources.tables import table
from . import experiments as X
from .q_aggregate import SENT_UNITS, pack_sql
from .q_core import distant_sql
from .q_sample_eval import AUC_SQL, X02_SEED
from .registry import query, rounded
from .sqlkit import method_ctes, nb_ctes, nb_score_ctes, prf_ctes, sql_hash, terms_cte, tfidf_ctes, weights_cte

GRID_SETTINGS = ["ce", "e", "c"]


METHODS = ["mnb", "bnb", "centroid", "knn"]


def _grid_sql_one(st: str, method: str) -> str:
    return f"""(WITH {distant_sql(st)}, {method_ctes(method, 'dw', 'tw')},
pred AS (SELECT id, label FROM ms WHERE pred), {prf_ctes('tids', 'pred')}, {AUC_SQL.replace('FROM scores s', 'FROM ms s')},
m AS (SELECT avg(precision) AS p, avg(recall) AS r, avg(f1) AS f FROM pc),
a AS (SELECT avg(auc) AS auc FROM auc WHERE auc IS NOT NULL)
SELECT '{method}' AS method, '{st}' AS setting, metric, value FROM (
  SELECT 'precision' AS metric, round(p, 6) AS value FROM m UNION ALL SELECT 'recall', round(r, 6) FROM m
  UNION ALL SELECT 'f1', round(f, 6) FROM m UNION ALL SELECT 'auc', round(auc, 6) FROM a))"""


GRID_SQL = " UNION ALL ".join(_grid_sql_one(s, m) for s in GRID_SETTINGS for m in METHODS)


def _grid(spark, d):
    return rounded(X.distant_grid(spark, d, GRID_SETTINGS, METHODS))


@query("r02_stopword_grid", f"SELECT * FROM ({GRID_SQL})")
def r02(spark, d):
    return _grid(spark, d)


@query("s21_experiment_grid", f"""WITH g AS (SELECT * FROM ({GRID_SQL}) WHERE metric = 'f1')
SELECT method, round(max(CASE WHEN setting = 'c' THEN value END), 3) AS c,
  round(max(CASE WHEN setting = 'ce' THEN value END), 3) AS ce,
  round(max(CASE WHEN setting = 'e' THEN value END), 3) AS e FROM g GROUP BY method""")
def s21(spark, d):
    g = _grid(spark, d).filter(F.col("metric") == "f1")
    return S.experiment_grid(g, "method", "setting", "value", 3).select("method", "c", "ce", "e")


@query("r07_best_setting", f"""WITH g AS (SELECT * FROM ({GRID_SQL}) WHERE metric = 'f1')
SELECT method, arg_min(setting, (-value, setting)) AS setting, max(value) AS f1 FROM g GROUP BY method""")
def r07(spark, d):
    g = _grid(spark, d).filter(F.col("metric") == "f1").withColumnRenamed("value", "f1")
    return A.fold_mean_best(g, "method", "setting", "f1")


@query("r08_best_with_auc", f"""WITH g AS (SELECT * FROM ({GRID_SQL})),
w AS (SELECT method, setting, max(CASE WHEN metric = 'f1' THEN value END) AS f1,
  max(CASE WHEN metric = 'auc' THEN value END) AS auc FROM g GROUP BY method, setting)
SELECT method, arg_min(setting, (-f1, setting)) AS setting, max(f1) AS f1, arg_min(auc, (-f1, setting)) AS auc
FROM w GROUP BY method""")
def r08(spark, d):
    g = _grid(spark, d)
    w = g.groupBy("method", "setting").pivot("metric", ["f1", "auc"]).agg(F.first("value"))
    b = w.groupBy("method").agg(F.min_by(F.struct("setting", "f1", "auc"), F.struct(-F.col("f1"), F.col("setting"))).alias("b"))
    return b.select("method", "b.setting", "b.f1", "b.auc")


#: Lines of a document alternate between two speakers; the odd ones are taken as the practitioner's.
def _speech(text):
    return F.concat_ws("\n", F.filter(nonempty_lines(text), lambda x, i: i % 2 == 0))


def _first_line(text):
    return F.coalesce(F.get(nonempty_lines(text), 0), F.lit(""))


LINES_SQL = "list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: length(x) > 0)"
SPEECH_SQL = f"array_to_string(list_filter({LINES_SQL}, lambda x, i: i % 2 = 1), chr(10))"
FIRST_SQL = f"coalesce({LINES_SQL}[1], '')"
#: Scenario: (dropped class, what of a scored document counts); description: what of a sampled document describes its class.
SCENARIOS = {"all": (None, None), "without_en": ("en", None), "speech_only": (None, (_speech, SPEECH_SQL))}
DESCRIPTIONS = {"whole": None, "first_line": (_first_line, FIRST_SQL)}


def _scenario_sql(scenario: str, description: str, method: str) -> str:
    drop, text = SCENARIOS[scenario]
    desc = DESCRIPTIONS[description]
    src = (f"(SELECT d.doc_id, CASE WHEN s.is_test THEN {desc[1] if desc else 'text'} ELSE {text[1] if text else 'text'} END AS text "
           "FROM documents d JOIN s ON s.id = d.doc_id)")
    return f"""(WITH {distant_sql(drop_label=drop, src=src)}, {method_ctes(method, 'dw', 'tw')},
pred AS (SELECT id, label FROM ms WHERE pred), {prf_ctes('tids', 'pred')}
SELECT '{scenario}' AS scenario, '{description}' AS description, '{method}' AS method, round(avg(precision), 6) AS precision,
  round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM pc)"""


R03_METHODS = ["mnb", "centroid"]


@query("r03_scenarios", " UNION ALL ".join(_scenario_sql(s, t, m) for s in SCENARIOS for t in DESCRIPTIONS for m in R03_METHODS))
def r03(spark, d):
    # one split and one prediction for all scenarios: each text is cut into terms once, and a dropped class is left out of the counts
    texts = {text and text[0]: text and text[0] for _, text in SCENARIOS.values()}
    runs = {(scenario, name): X.Run(f"{scenario}|{name}", "ce", drop, text and text[0], name)
            for scenario, (drop, text) in SCENARIOS.items() for name in DESCRIPTIONS}
    s = X.grid_runs(spark, d, list(runs.values()), texts=texts, descriptions={n: x and x[0] for n, x in DESCRIPTIONS.items()})
    pred, out = written(s.predict(R03_METHODS), "grid-predictions"), None
    for (scenario, name), r in runs.items():
        one = [x.filter(F.col("key") == r.key).withColumn("key", F.lit(r.setting)) for x in (s.gold, pred)]
        m = E.macro(X.grid_per_class(*one), "method").select(F.lit(scenario).alias("scenario"), F.lit(name).alias("description"), "method", "precision", "recall", "f1")
        out = m if out is None else out.unionByName(m)
    return rounded(out)


DEVTEST_SQL = f"""dt AS (SELECT id, rn <= ceil(n * 0.2) AS is_test FROM (
  SELECT id, row_number() OVER (PARTITION BY label ORDER BY h, id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM (
    SELECT doc_id AS id, lang AS label, {sql_hash(X02_SEED, 'lang', 'doc_id')} AS h FROM documents)))"""


def _devtest_sql(method: str) -> str:
    return f"""(WITH {distant_sql()}, {DEVTEST_SQL}, {method_ctes(method, 'dw', 'tw')},
pred AS (SELECT id, label FROM ms WHERE pred),
gd AS (SELECT t.id, t.label FROM tids t JOIN dt USING (id) WHERE NOT dt.is_test),
pd AS (SELECT p.id, p.label FROM pred p JOIN dt USING (id) WHERE NOT dt.is_test),
gt AS (SELECT t.id, t.label FROM tids t JOIN dt USING (id) WHERE dt.is_test),
pt AS (SELECT p.id, p.label FROM pred p JOIN dt USING (id) WHERE dt.is_test),
{prf_ctes('gd', 'pd', 'pcd')}, {prf_ctes('gt', 'pt', 'pct')}
SELECT '{method}' AS method, 'dev' AS split, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM pcd
UNION ALL SELECT '{method}', 'test', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM pct)"""


@query("r04_dev_test", " UNION ALL ".join(_devtest_sql(m) for m in METHODS))
def r04(spark, d):
    s = X.grid_setup(spark, d, ["ce"])
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    side = multilabel_split(docs, X02_SEED, 0.2).select("id", F.when(F.col("is_test"), "test").otherwise("dev").alias("key"))
    # the two sides are evaluated as the two keys of one run
    pred = written(s.predict(METHODS).drop("key"), "grid-predictions").join(side, "id")
    m = E.macro(X.grid_per_class(s.gold.join(side, "id"), pred), "method", "key")
    return rounded(m.select("method", F.col("key").alias("split"), "precision", "recall", "f1"))


def _sup_sql(train: str, test: str, label_filter: str = "", method: str = "mnb", setting: str = "ce") -> str:
    """Supervised chain over documents: ``train``/``test`` are id subqueries."""
    return f"""(WITH {_sup_ctes(train, test, method, setting)},
pred AS (SELECT id, label FROM ms WHERE pred), {prf_ctes('tids', 'pred')}
SELECT avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM pc {label_filter})"""


def _sup_ctes(train: str, test: str, method: str, setting: str) -> str:
    return f"""{terms_cte('documents', 'doc_id', 'text', setting, 'cnt')},
trc AS (SELECT id, term, tf FROM cnt WHERE id IN ({train})),
{tfidf_ctes('trc', 'v', n=f'SELECT count(*) AS n FROM documents WHERE doc_id IN ({train})')}, {weights_cte('trw', 'trc', 'v_vocab')},
tec AS (SELECT id, term, tf FROM cnt WHERE id IN ({test})), {weights_cte('tew', 'tec', 'v_vocab')},
ty AS (SELECT doc_id AS id, lang AS label FROM documents WHERE doc_id IN ({train})),
tids AS (SELECT doc_id AS id, lang AS label FROM documents WHERE doc_id IN ({test})),
{nb_ctes('trw', 'ty', 'v_vocab')}, {nb_score_ctes('tids', 'tew')}, {method_ctes(method, 'trw', 'tew')}"""


_DT = f"SELECT id FROM (WITH {DEVTEST_SQL} SELECT * FROM dt) WHERE {{}}"


def _single_split(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    sp = multilabel_split(docs, X02_SEED, 0.2).select("id", F.col("is_test").cast("int").alias("fold"))
    return X.folds_setup(spark, d, sp, [1], ["ce"])


@query("r05_single_split", " UNION ALL ".join(f"""SELECT '{m}' AS method, '{name}' AS scenario, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1 FROM {_sup_sql(_DT.format('NOT is_test'), _DT.format('is_test'), where, m)}"""
                                              for m in METHODS for name, where in (("all", ""), ("without_en", "WHERE label <> 'en'"))))
def r05(spark, d):
    s = _single_split(spark, d)
    pc = X.grid_per_class(s.gold, written(s.predict(METHODS), "folds-predictions"))
    a = E.macro(pc, "method").withColumn("scenario", F.lit("all"))
    b = E.macro(pc.filter(F.col("label") != "en"), "method").withColumn("scenario", F.lit("without_en"))
    return rounded(a.unionByName(b).select("method", "scenario", "precision", "recall", "f1"))


@query("m06_knn_tfidf", f"""WITH {_sup_ctes(_DT.format('NOT is_test'), _DT.format('is_test'), 'knn', 'ce')}
SELECT id, label, pred, round(score, 6) AS score FROM ms WHERE score > 0""")
def m06_tfidf(spark, d):
    """k nearest training documents of every test document on TF-IDF rows, exact."""
    s = _single_split(spark, d)
    return rounded(s.predict(["knn"]).select("id", "label", "pred", "score"))


def _svm_on_split(spark, d, method):
    s = _single_split(spark, d)
    if s.train_v is None:  # ids that come several times
        one = s.train_y.select("id", "label"), s.test_ids.select("id"), s.named(s.test_x).drop("key"), s.vocab.select(F.col("name").alias("term"))
        return rounded(M.classify(method, s.named(s.train_x).drop("key"), *one))
    key = "ce|1"
    names = {r["term"]: r["name"] for r in bounded_rows(s.vocab.filter(F.col("key") == key), X.MAX_FEATURES, "vocabulary")}
    one = s.train_y.select("id", "label"), s.test_ids.select("id"), s.test_v.named(key, names, s.test_ids), s.vocab.select(F.col("name").alias("term"))
    return rounded(M.classify(method, s.train_v.named(key, names), *one))


@query("m03_svm_tfidf")
def m03_tfidf(spark, d):
    """Rows-only: random features have no SQL twin; tests hold the solver against the optimum of every class."""
    return _svm_on_split(spark, d, "svm")


@query("m04_binary_svm_tfidf")
def m04_tfidf(spark, d):
    return _svm_on_split(spark, d, "bsvm")


@query("m13_classifier_dispatch", " UNION ALL ".join(
    f"""(WITH {_sup_ctes(_DT.format('NOT is_test'), _DT.format('is_test'), m, 'ce')}
SELECT '{m}' AS method, label, count(*) FILTER (WHERE pred) AS n_pred, round(sum(score), 4) AS total FROM ms GROUP BY label)""" for m in METHODS))
def m13(spark, d):
    """Every method by its name on the same features: documents predicted and summed scores per class."""
    p = _single_split(spark, d).predict(METHODS)
    return rounded(p.groupBy("method", "label").agg(F.count(F.when(F.col("pred"), 1)).alias("n_pred"), F.round(F.sum("score"), 4).alias("total")))


FOLD_K = 5
FOLD_SETTINGS = ["ce", "e"]
_FOLDS = f"""SELECT id FROM (SELECT doc_id AS id, (row_number() OVER (PARTITION BY lang ORDER BY
  {sql_hash(3, 'doc_id')}, doc_id) - 1) % {FOLD_K} AS fold FROM documents) WHERE fold {{}} {{}}"""


def _kfold_sql(settings: list) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS method, '{st}' AS setting, {f} AS fold, precision, recall, f1 FROM "
                              f"{_sup_sql(_FOLDS.format('<>', f), _FOLDS.format('=', f), '', m, st)}"
                              for m in METHODS for st in settings for f in range(FOLD_K))


@query("r06_kfold_mean", f"""SELECT method, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
  round(avg(f1), 6) AS f1 FROM ({_kfold_sql(['ce'])}) GROUP BY method""")
def r06(spark, d):
    r = X.fold_runs(spark, d, FOLD_K, 3, METHODS, ["ce"])
    return rounded(r.groupBy("method").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")))


@query("a13_fold_mean_best", f"""WITH m AS (SELECT method, setting, round(avg(f1), 6) AS f1 FROM ({_kfold_sql(FOLD_SETTINGS)}) GROUP BY method, setting)
SELECT method, arg_min(setting, (-f1, setting)) AS setting, max(f1) AS f1 FROM m GROUP BY method""")
def a13(spark, d):
    r = X.fold_runs(spark, d, FOLD_K, 3, METHODS, FOLD_SETTINGS)
    mean = rounded(r.groupBy("method", "setting").agg(F.avg("f1").alias("f1")))
    return rounded(A.fold_mean_best(mean, "method", "setting", "f1"))


MAJ_SQL = """mp AS (SELECT source, arg_min(lang, (-n, lang)) AS code FROM (
  SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source)"""


@query("r09_fine_to_coarse_eval", f"""WITH {distant_sql(label='source')}, {MAJ_SQL},
pf AS (SELECT id, label FROM scores WHERE score > 0.1),
pred AS (SELECT DISTINCT pf.id, mp.code AS label FROM pf JOIN mp ON mp.source = pf.label WHERE mp.code <> 'Z'),
gold AS (SELECT t.id, d.lang AS label FROM tids t JOIN documents d ON d.doc_id = t.id),
{prf_ctes('gold', 'pred')}
SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM pc""")
def r09(spark, d):
    s = X.distant_setup(spark, d, label_col="source")
    p = X.distant_nb(s).filter("pred").select("id", "label")
    docs = table(spark, d, "documents")
    cnt = docs.groupBy(F.col("source").alias("label"), F.col("lang").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    mp = cnt.groupBy("label").agg(F.min_by("code", F.struct(-F.col("n"), F.col("code"))).alias("code"))
    coarse = J.fine_to_coarse(p, mp, "label", "code", "Z")
    gold = s.test_ids.join(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label")), "id")
    return rounded(E.evaluate(gold, coarse))


R10_SQL = f"""WITH RECURSIVE {distant_sql()},
units AS (SELECT id, pos, s FROM (SELECT doc_id AS id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS s
  FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\\s](?:[^.!?]*[^.!?\\s])?[.!?]*') AS s FROM documents))
  WHERE id IN (SELECT id FROM tids)),
{pack_sql('units')},
ck AS (SELECT id || ':' || chunk_id AS cid, id AS doc, text FROM chunks),
{terms_cte('ck', 'cid', 'text', 'ce', 'kc')},
{weights_cte('kw', 'kc', 'v_vocab')},
kids AS (SELECT cid AS id FROM ck),
{nb_score_ctes('kids', 'kw', 'nb', 'ks')},
merged AS (SELECT ck.doc AS id, ks.label, bool_or(ks.score > 0.1) AS pred, max(ks.score) AS score
  FROM ks JOIN ck ON ck.cid = ks.id GROUP BY ck.doc, ks.label),
pred AS (SELECT id, label FROM merged WHERE pred),
{prf_ctes('tids', 'pred')},
scores2 AS (SELECT * FROM merged),
{AUC_SQL.replace('FROM scores s', 'FROM scores2 s')}
SELECT round((SELECT avg(precision) FROM pc), 6) AS precision, round((SELECT avg(recall) FROM pc), 6) AS recall,
  round((SELECT avg(f1) FROM pc), 6) AS f1, round((SELECT avg(auc) FROM auc WHERE auc IS NOT NULL), 6) AS auc"""


@query("r10_chunk_scoring_flow", R10_SQL)
def r10(spark, d):
    from ..functions.text import sentences
    from ..operators.chunk import pack_units
    s = X.distant_setup(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").join(s.test_ids, "id", "left_semi")
    ch = pack_units(docs.select("id", sentences(F.col("text")).alias("units")), ["id"], "units", 120)
    # texts are packed once and chunks are scored once, for all that reads them
    keyed = written(ch.select(F.concat_ws(":", "id", "chunk_id").alias("cid"), "text"), "chunks", "zstd")
    sc = X.score_texts(s, keyed, "cid", "text")
    doc = F.regexp_extract("id", "(?s)^(.*):", 1).cast(docs.schema["id"].dataType).alias("doc_id")
    cp = sc.select(doc, "label", (F.col("score") > 0.1).alias("pred"), "score")
    merged = written(A.merge_chunks(cp, "doc_id").withColumnRenamed("doc_id", "id"), "merged")
    met = E.evaluate(s.gold, merged.filter("pred"))
    auc = E.macro_auc(E.roc_auc(s.gold, merged.select("id", "label", F.round("score", 10).alias("score")), s.test_ids))
    long = met.unpivot([], ["precision", "recall", "f1"], "k", "v").unionByName(
        auc.select(F.lit("auc").alias("k"), F.col("auc").alias("v")))
    return rounded(long.groupBy().pivot("k", ["precision", "recall", "f1", "auc"]).agg(F.first("v")))


def _clean_sql(col):
    from .sqlkit import stop_sql
    return (f"array_to_string(list_filter(list_filter(list_filter(regexp_split_to_array(lower({col}), '\\s+'), "
            f"lambda x: len(x) > 0), lambda x: NOT list_contains({stop_sql('c')}, x)), "
            f"lambda x: NOT list_contains({stop_sql('e')}, x)), ' ')")


@query("r11_prepare_dataset", f"""SELECT conv_id,
  coalesce(string_agg({_clean_sql('text')}, ' ' ORDER BY turn), '') AS text_all,
  coalesce(string_agg({_clean_sql('text')}, ' ' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS text_gp,
  coalesce(string_agg({_clean_sql('text')}, ' ' ORDER BY turn) FILTER (WHERE role = 'user'), '') AS text_patient
FROM conversations GROUP BY conv_id""")
def r11(spark, d):
    from ..functions import text as T
    from ..functions.stopwords import stopword_list
    from ..operators import structure as D
    c = table(spark, d, "conversations")
    sp = F.when(F.col("role") == "user", "Patient").when(F.col("role") == "assistant", "GP").otherwise("Info")
    t = c.select("conv_id", "turn", sp.alias("speaker"),
                 T.preprocess("text", stopword_list("c"), stopword_list("e")).alias("text"))
    ids = c.select("conv_id").distinct()
    out = ids
    for name, kw in (("text_all", dict()), ("text_gp", dict(patient=False, info=False)),
                     ("text_patient", dict(gp=False, info=False))):
        j = D.joined_text(D.role_filter(t, **kw), "conv_id", "turn", "text").withColumnRenamed("text", name)
        out = out.join(j, "conv_id", "left")
    return out.na.fill("", ["text_all", "text_gp", "text_patient"])


@query("j08_description_source_switch", f"""WITH {terms_cte('documents', 'doc_id', 'text', 'ce')},
src AS (SELECT doc_id AS id, lang AS label, CAST(substring(source, 4) AS INTEGER) < 10 AS is_a FROM documents),
b AS (SELECT mode, label, term, sum(tf) AS tf FROM (
  SELECT CASE WHEN is_a THEN 'a' ELSE 'b' END AS mode, label, term, tf FROM cnt JOIN src USING (id)
  UNION ALL SELECT 'ab', label, term, tf FROM cnt JOIN src USING (id)) GROUP BY mode, label, term)
SELECT mode, label, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS total_tf FROM b GROUP BY mode, label""")
def j08(spark, d):
    from ..functions.stopwords import stopword_list
    from ..operators.vectorize import term_counts
    docs = table(spark, d, "documents")
    c = term_counts(docs, "doc_id", "text", stopword_list("ce"))
    src = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"),
                      (F.substring("source", 4, 10).cast("int") < 10).alias("is_a"))
    j = c.join(src, "id")
    a = j.filter("is_a").groupBy("label", "term").agg(F.sum("tf").alias("tf"))
    b = j.filter("NOT is_a").groupBy("label", "term").agg(F.sum("tf").alias("tf"))
    out = None
    for mode in ("a", "b", "ab"):
        bag = J.description_switch(a, b, mode)
        r = bag.groupBy("label").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").cast("bigint").alias("total_tf")) \
            .select(F.lit(mode).alias("mode"), "*")
        out = r if out is None else out.unionByName(r)
    return out


@query("j12_truth_vs_pred", f"""WITH {distant_sql()}, pred AS (SELECT id, label FROM scores WHERE score > 0.1)
SELECT t.id, 'en' AS gold, coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM pred p WHERE p.id = t.id), '') AS pred
FROM tids t WHERE t.label = 'en'""")
def j12(spark, d):
    s = X.distant_setup(spark, d)
    p = X.distant_nb(s)
    return J.truth_vs_pred(s.gold, p.filter("pred"), "en")


@query("j13_granularity_switch", f"""SELECT 'coarse' AS granularity, count(DISTINCT lang) AS n_labels FROM documents
UNION ALL SELECT 'fine', count(DISTINCT source) FROM documents""")
def j13(spark, d):
    docs = table(spark, d, "documents")
    out = None
    for g in ("coarse", "fine"):
        lab = J.granularity_labels(docs, g, coarse_col="lang", fine_col="source")
        r = lab.agg(F.countDistinct("label").alias("n_labels")).select(F.lit(g).alias("granularity"), "n_labels")
        out = r if out is None else out.unionByName(r)
    return out


@query("j14_inspect_document", f"""WITH {distant_sql()}, pred AS (SELECT id, label FROM scores WHERE score > 0.1),
one AS (SELECT min(id) AS id FROM tids),
cos AS (SELECT t.id, d.id AS label, sum(t.w * d.w) AS cosine FROM tw t JOIN dw d USING (term) WHERE t.id = (SELECT id FROM one)
  GROUP BY t.id, d.id)
SELECT o.id, (SELECT string_agg(label, ',' ORDER BY label) FROM tids WHERE id = o.id) AS gold,
  coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM pred WHERE id = o.id), '') AS pred,
  (SELECT string_agg(label || '=' || CAST(round(cosine, 4) AS VARCHAR), ',' ORDER BY label) FROM cos) AS similarity
FROM one o""")
def j14(spark, d):
    s = X.distant_setup(spark, d)
    p = X.distant_nb(s)
    one = s.test_ids.agg(F.min("id").alias("id"))
    return J.inspect_document(one, s.gold, p.filter("pred"), s.test_x, s.desc_w)
