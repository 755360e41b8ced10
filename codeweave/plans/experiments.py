"""Experiment flows (R01-R11) composed from the operators.

Distant supervision on the driver's tables: gold label = a document column
(``lang`` by default); the "description" of each label is the union of the term
bags of a seeded per-label sample of documents (X01) -- the long-form twin of
concatenating their texts (no bigram is formed across two documents, and no
label's text is ever materialised as one giant string). The remaining documents
are scored and evaluated.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stopwords import stopword_list
from ..operators import classify as M
from ..operators import evaluate as E
from ..operators.sample import group_split, stratified_folds, written_cutoffs
from ..operators import keyed as K
from ..operators import termcount as C
from ..operators.scan import written
from ..session import bounded_rows
from ..operators.vectorize import fit_vocabulary, term_counts, term_counts_by, tfidf, unit, weighted
from ..sources.tables import table

DESC_SEED = 7
DESC_FRACTION = 0.2
MAX_FEATURES = 5000
#: Most rows (id, fold) that are sent to all tasks.
NARROW_ROWS = 2_000_000


@dataclass
class DistantSetup:
    counts: DataFrame      # (id, term, tf) of every document
    split: DataFrame       # (id, label, is_test): is_test = description sample
    desc_counts: DataFrame  # (id=label, term, tf)
    vocab: DataFrame
    vocab_size: int
    desc_w: DataFrame      # (id=label, term, w)
    test_ids: DataFrame    # (id)
    test_x: DataFrame      # (id, term, w)
    test_raw: DataFrame    # (id, term, w) before scaling to unit length
    gold: DataFrame        # (id, label)
    terms: list            # the vocabulary's terms, max_features at most


def distant_setup(spark: SparkSession, sf_dir: str, label_col: str = "lang", stop_sets: str = "ce",
                  seed=DESC_SEED, fraction: float = DESC_FRACTION, max_features: int = MAX_FEATURES,
                  drop_label: str | None = None) -> DistantSetup:
    docs = table(spark, sf_dir, "documents")
    if drop_label is not None:  # "without class X": its documents and its description both go
        docs = docs.filter(F.col(label_col) != drop_label)
    stop = stopword_list(stop_sets)
    rows = docs.select(F.col("doc_id").alias("id"), F.col(label_col).alias("label"), "text")
    # The split is one cutoff per label, applied at the scan: no text is shuffled for the flag
    # (only an input with fewer splits than cores is spread).
    cut = written_cutoffs(rows.select("id", "label"), ["label"], "id", fraction, seed)
    split = group_split(rows.select("id", "label"), ["label"], "id", fraction, seed, cut).select("id", "label", "is_test")
    dj = group_split(rows, ["label"], "id", fraction, seed, cut)
    # Each document is on one side, so counting the sides apart counts no text twice; the counts of all documents
    # are never stored, only those of the labels.
    counts = term_counts(dj, "id", "text", stop)
    described = term_counts(dj.filter("is_test"), "id", "text", stop, keep=["label"])
    desc_counts = written(described.groupBy(F.col("label").alias("id"), "term").agg(F.sum("tf").alias("tf")), "desc-counts")
    n_desc = split.filter("is_test").select("label").distinct().count()
    vocab = fit_vocabulary(desc_counts, max_features, n_desc).cache()
    terms = [r["term"] for r in bounded_rows(vocab.select("term"), max_features, "vocabulary")]
    desc_w = tfidf(desc_counts, vocab).persist(StorageLevel.MEMORY_AND_DISK)  # labels x vocabulary
    test = split.filter(~F.col("is_test"))
    test_raw = weighted(term_counts(dj.filter(~F.col("is_test")), "id", "text", stop, only=terms), vocab)
    return DistantSetup(counts, split, desc_counts, vocab, len(terms), desc_w,
                        test.select("id"), unit(test_raw), test_raw, test.select("id", "label"), terms)


def distant_nb(s: DistantSetup, alpha: float = 0.001, t: float = 0.1) -> DataFrame:
    """R01 with M01: predictions (id, label, pred, score)."""
    train_y = s.desc_w.select("id").distinct().withColumn("label", F.col("id"))
    return M.multinomial_nb(s.desc_w, train_y, s.test_ids, s.test_raw, s.vocab_size, alpha, t, raw=True)


def distant_predict(s: DistantSetup, method: str = "mnb") -> DataFrame:
    """Classifier chosen by name, one contract."""
    train_y = s.desc_w.select("id").distinct().withColumn("label", F.col("id"))
    return M.classify(method, s.desc_w, train_y, s.test_ids, s.test_x, s.vocab)


def distant_run(spark: SparkSession, sf_dir: str, method: str = "mnb", **kw) -> DataFrame:
    s = distant_setup(spark, sf_dir, **kw)
    pred = distant_predict(s, method)
    return E.evaluate(s.gold, pred.filter("pred")).select(F.lit(method).alias("method"), "*")


@dataclass
class GridSetup:
    """Features of all settings of a grid, keyed by ``key``; terms are numbers, their texts are in ``vocab``."""
    train_x: DataFrame     # (key, id=label, term, w)
    train_y: DataFrame     # (key, id, label)
    test_ids: DataFrame    # (key, id)
    test_x: DataFrame      # (key, id, term, w)
    vocab: DataFrame       # (key, term, name)
    gold: DataFrame        # (id, label)
    train_v: K.Vectors | None = None  # train_x and test_x as they are stored, where an id comes once
    test_v: K.Vectors | None = None

    def predict(self, methods: list) -> DataFrame:
        train, test = (x if v is None else v for x, v in ((self.train_x, self.train_v), (self.test_x, self.test_v)))
        return K.predict(methods, train, self.train_y, self.test_ids, test, self.vocab)

    def named(self, x: DataFrame) -> DataFrame:
        """Rows (key, id, term, w) with the terms' texts."""
        return x.join(F.broadcast(self.vocab), ["key", "term"]).select("key", "id", F.col("name").alias("term"), "w")


def _numbered(vocab: DataFrame, setting) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (key, term, idf): the tables of :func:`keyed.numbered`, stored, and (key, term=number, name)."""
    v = vocab.withColumn("setting", setting)
    terms, idfs = (written(x, "grid-terms") for x in K.numbered(v))
    return terms, idfs, v.join(terms, ["setting", "term"]).select("key", F.col("t").alias("term"), F.col("term").alias("name"))


def _numbers(terms: DataFrame, most: int) -> dict:
    """By setting the number of each term of the vocabularies (setting, term, t), ``most`` in all."""
    out: dict = {}
    for r in bounded_rows(terms.select("setting", "term", "t"), most, "vocabulary"):
        out.setdefault(r["setting"], {})[r["term"]] = r["t"]
    return out


def _added(sums: DataFrame, name: str) -> DataFrame:
    """Sums of slices (key, fold, term, tf, df) added up and stored."""
    return written(sums.groupBy("key", "fold", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")), name, "zstd")


@dataclass
class Run:
    """One distant run of a grid: what its results are keyed by, its stopwords, the class it does without, and the names
    of what counts of a scored document's text and of a description's."""
    key: str
    setting: str
    drop: str | None = None
    text: str | None = None
    description: str | None = None


def grid_runs(spark: SparkSession, sf_dir: str, runs: list, label_col: str = "lang", seed=DESC_SEED, fraction: float = DESC_FRACTION,
              max_features: int = MAX_FEATURES, texts: dict | None = None, descriptions: dict | None = None) -> GridSetup:
    """Distant supervision for several runs over one split; ``texts`` and ``descriptions``: name -> what of a text counts
    (None: all of it). A document is on one side and is cut into terms once per name of its side. Without ``drop`` its
    documents and its description go; cutoffs are per label, so the others' split stays. ``gold`` has the run's key
    where one drops a class."""
    texts, descriptions = texts or {None: None}, descriptions or {None: None}
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col(label_col).alias("label"), "text")
    cut = written_cutoffs(rows.select("id", "label"), ["label"], "id", fraction, seed)
    split = group_split(rows.select("id", "label"), ["label"], "id", fraction, seed, cut)
    dj = group_split(rows, ["label"], "id", fraction, seed, cut)
    stops = {st: stopword_list(st) for st in dict.fromkeys(r.setting for r in runs)}
    places = {name: str(i) for i, name in enumerate(texts)}
    group = {r.key: f"{places[r.text]}|{r.setting}" for r in runs}  # runs that share a text's bags, and the numbers of terms

    def counted(side, part, count):
        text = F.col("text") if part is None else part(F.col("text"))
        return term_counts_by(dj.filter(side).withColumn("text", text), "id", "text", stops, ["label"], count=count)

    def of_runs(df, some, label="label"):
        """Rows (setting, label, ...) of each of the runs ``some`` with its key, without the class it drops."""
        each: dict = {}
        for r in some:
            each.setdefault(r.setting, []).append(F.struct(F.lit(r.key).alias("key"), F.lit(r.drop).cast("string").alias("drop")))
        by = F.create_map(*[x for st, e in each.items() for x in (F.lit(st), F.array(*e))])
        out = df.withColumn("_e", F.explode(F.element_at(by, F.col("setting")))).filter(F.expr(f"_e.drop is null or `{label}` <> _e.drop"))
        return out.withColumn("key", F.col("_e.key")).drop("_e")
    desc = None
    for name, part in descriptions.items():
        some = [r for r in runs if r.description == name]
        if not some:
            continue

        def sums(t, store, **kw):
            x = C.totals(t, stops, "label", **kw).groupBy(F.col("key").alias("setting"), F.col("label").alias("id"), "term").agg(F.sum("tf").alias("tf"))
            return of_runs(written(x, store), some, "id")
        t = counted(F.col("is_test"), part, lambda t: written(t, "described-tokens", "zstd"))
        at = K.last_totals(sums(t, "grid-words", single=True), max_features)  # as of the folds
        least = {st: [at.get(r.key) for r in some if r.setting == st] for st in stops}
        frequent = C.frequent_pairs(t, stops, {st: None if None in x else min(x, default=None) for st, x in least.items()})
        own = sums(t, "grid-described", frequent=frequent)
        desc = own if desc is None else desc.unionByName(own)
    sides = split.crossJoin(F.broadcast(spark.createDataFrame([(st,) for st in stops], "setting string")))
    sides = of_runs(sides, runs)
    n_desc = sides.filter("is_test").groupBy("key").agg(F.countDistinct("label").alias("n"))
    of_key = F.element_at(F.create_map(*[F.lit(x) for kv in group.items() for x in kv]), F.col("key"))
    terms, idfs, vocab = _numbered(written(K.vocabulary(desc, n_desc, max_features), "grid-vocabulary"), of_key)
    described = K.bags(desc.select(of_key.alias("key"), "id", "term", "tf", F.col("key").alias("run")), terms, "run")
    train_x = written(K.unit_rows(described.withColumnRenamed("run", "key"), idfs), "grid-train")
    numbers = _numbers(terms, max_features * len(runs))
    test_x = None
    for name, part in texts.items():
        some = [r for r in runs if r.text == name]
        if not some:
            continue
        own = {st: numbers.get(f"{places[name]}|{st}", {}) for st in stops}
        bags = written(counted(~F.col("is_test"), part, lambda t: C.bags(t, stops, own, ["label"])), "grid-bags")
        bags = of_runs(bags, some).select("key", "id", "bag", of_key.alias("setting"))
        test_x = bags if test_x is None else test_x.unionByName(bags)
    test = sides.filter(~F.col("is_test"))
    several = C.repeated(split.filter(~F.col("is_test")))
    test_x = C.once(test_x, several)
    test_v = None if several else K.Vectors(test_x.select("setting", F.array("key").alias("keys"), "id", "bag"), idfs, len(runs))
    test_x = K.unit_rows(test_x, idfs)
    train_y = train_x.select("key", "id").distinct().withColumn("label", F.col("id"))
    gold = test.select("key", "id", "label") if any(r.drop is not None for r in runs) else split.filter(~F.col("is_test")).select("id", "label")
    return GridSetup(train_x, train_y, test.select("key", "id"), test_x, vocab, gold, None, test_v)


def grid_setup(spark: SparkSession, sf_dir: str, settings: list, drop_label: str | None = None, **kw) -> GridSetup:
    """Distant supervision for several stopword settings in one pass over the texts."""
    return grid_runs(spark, sf_dir, [Run(st, st, drop_label) for st in settings], **kw)


def folds_setup(spark: SparkSession, sf_dir: str, folds: DataFrame, cvs: list, settings: list, label_col: str = "lang",
                max_features: int = MAX_FEATURES) -> GridSetup:
    """Supervision by documents: for each setting and each ``cv`` of ``cvs`` the folds other than cv train and cv is
    scored; keys are 'setting|cv'. ``folds`` is (id, fold). Texts are read once for all of them, and a document's counts
    of the vocabulary are stored once: weights of the folds it trains are made from them in the row."""
    docs = table(spark, sf_dir, "documents")
    label = docs.select(F.col("doc_id").alias("id"), F.col(label_col).alias("label"))
    folds = written(folds.select("id", "fold"), "folds")
    few = folds.count() <= NARROW_ROWS  # no text is shuffled for its fold; beyond, texts are dealt by id
    first = label.groupBy("id").agg(F.min("label").alias("label"))
    labelled = written(folds.join(first, "id", "left").select("id", "fold", "label"), "folds-first-labels")
    dj = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(labelled) if few else labelled.hint("shuffle_hash"), "id")
    stops = {x: stopword_list(x) for x in settings}
    # texts are cut once; bounds of the vocabularies come from the words, so that few of the pairs are counted exactly
    t = term_counts_by(dj, "id", "text", stops, ["fold", "label"], few, count=lambda t: written(t, "folds-tokens", "zstd"))
    words = _added(C.totals(t, stops, "fold", single=True), "folds-words")
    frequent = C.frequent_pairs(t, stops, K.least_totals(words, settings, cvs, max_features))
    c = _added(C.totals(t, stops, "fold", frequent=frequent), "folds-totals")
    trains = F.filter(F.array(*[F.lit(cv) for cv in cvs]), lambda x: x != F.col("fold"))
    name = F.concat_ws("|", "setting", "cv").alias("key")
    st = F.explode(F.array(*[F.lit(x) for x in settings])).alias("setting")
    train_ids = folds.select("id", F.explode(trains).alias("cv")).select("id", "cv", st).select(name, "id")
    test_ids = folds.filter(F.col("fold").isin(cvs)).select("id", F.col("fold").alias("cv"), st).select(name, "id")
    n_docs = train_ids.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    terms, idfs, vocab = _numbered(written(K.fold_vocabulary(c, cvs, n_docs, max_features), "folds-vocabulary"), F.split("key", "[|]")[0])
    numbers = _numbers(terms, max_features * len(cvs) * len(settings))
    bagged = C.bags(t, stops, {x: numbers.get(x, {}) for x in settings}, ["fold", "label"])
    several = C.repeated(t)
    bags = written(C.once(bagged, several), "folds-bags")

    def keys(of):
        return F.transform(of, lambda cv: F.concat_ws("|", "setting", cv)).alias("keys")
    trained = bags.select("setting", keys(trains), "id", "bag", "label")
    asked = bags.filter(F.col("fold").isin(cvs)).select("setting", keys(F.array("fold")), "id", "bag")
    train_v, test_v = (K.Vectors(x, idfs, len(cvs) * len(settings)) for x in (trained, asked))
    return GridSetup(train_v.long(), written(train_ids.join(first, "id").select("key", "id", "label"), "folds-labels"), test_ids,
                     test_v.long(), vocab, test_ids.join(label, "id").select("key", "id", "label"), *((None, None) if several else (train_v, test_v)))


def grid_per_class(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """E01 for every run: (method, key, label, tp, fp, fn, support, precision, recall, f1) of predictions
    (method, key, id, label, pred); gold is (id, label) for all runs, or (key, id, label)."""
    run, both = F.concat_ws("|", "method", "key"), F.concat_ws("|", "method", "key", "label").alias("label")
    runs = pred.select("method", "key").distinct().withColumn("_", F.lit(1))
    g = gold.withColumn("_", F.lit(1)).join(runs, ["key", "_"] if "key" in gold.columns else ["_"])
    pc = E.per_class(g.select("id", both), pred.filter("pred").select("id", both))
    n = F.size(F.split("label", "[|]"))
    parts = F.split("label", "[|]")
    return pc.select(parts[0].alias("method"), F.array_join(F.slice(parts, F.lit(2), n - 2), "|").alias("key"), F.element_at(parts, -1).alias("label"),
                     *[c for c in pc.columns if c != "label"])


def grid_metrics(gold: DataFrame, pred: DataFrame, auc: bool = True) -> DataFrame:
    """(method, key, metric, value): macro precision, recall, F1 and AUC of every run of predictions
    (method, key, id, label, pred, score); gold (id, label) is the same for all runs."""
    out = E.macro(grid_per_class(gold, pred), "method", "key").unpivot(["method", "key"], ["precision", "recall", "f1"], "metric", "value")
    if auc:
        both = F.concat_ws("|", "method", "key", "label").alias("label")
        g = gold.withColumn("_", F.lit(1)).join(pred.select("method", "key").distinct().withColumn("_", F.lit(1)), "_")
        a = E.roc_auc(g.select("id", both), pred.select("id", both, F.round("score", 10).alias("score")), gold.select("id"))
        parts = F.split("label", "[|]")
        a = a.filter("auc is not null").select(parts[0].alias("method"), parts[1].alias("key"), "auc")
        out = out.unionByName(a.groupBy("method", "key").agg(F.avg("auc").alias("value")).select("method", "key", F.lit("auc").alias("metric"), "value"))
    return out


def distant_grid(spark: SparkSession, sf_dir: str, settings: list, methods: list, **kw) -> DataFrame:
    """Stopword setting x method grid in long form (method, setting, metric, value) with metric in
    precision/recall/f1/auc; all settings and methods in one pass over the texts."""
    s = grid_setup(spark, sf_dir, settings, **kw)
    pred = written(s.predict(methods), "grid-predictions")
    return grid_metrics(s.gold, pred).select("method", F.col("key").alias("setting"), "metric", "value")


def supervised_setup(spark: SparkSession, sf_dir: str, train_ids: DataFrame, test_ids: DataFrame,
                     label_col: str = "lang", stop_sets: str = "ce", max_features: int = MAX_FEATURES):
    """Transcript-style supervision: TF-IDF fitted on the training documents,
    NB trained on their first label, scored on the test documents."""
    docs = table(spark, sf_dir, "documents")
    stop = stopword_list(stop_sets)
    lab = docs.select(F.col("doc_id").alias("id"), F.col(label_col).alias("label"))
    tagged = (train_ids.select("id", F.lit(True).alias("is_train"))
              .unionByName(test_ids.select("id", F.lit(False).alias("is_train"))))
    dj = docs.select(F.col("doc_id").alias("id"), "text").join(tagged.hint("shuffle_hash"), "id")
    c = term_counts(dj, "id", "text", stop, keep=["is_train"], spread_input=False).persist(StorageLevel.MEMORY_AND_DISK)
    trc = c.filter("is_train").select("id", "term", "tf")
    vocab = fit_vocabulary(trc, max_features, lab.join(train_ids.select("id"), "id", "left_semi").count()).cache()
    vsize = vocab.count()
    train_x = tfidf(trc, vocab)
    test_x = tfidf(c.filter(~F.col("is_train")).select("id", "term", "tf"), vocab)
    train_y = lab.join(train_ids.select("id"), "id", "left_semi")
    gold = lab.join(test_ids.select("id"), "id", "left_semi")
    pred = M.multinomial_nb(train_x, train_y, test_ids.select("id"), test_x, vsize)
    return gold, pred


def fold_runs(spark: SparkSession, sf_dir: str, k: int, seed, methods: list, settings: list) -> DataFrame:
    """Stratified k-fold (X04) metrics (method, setting, fold, precision, recall, f1) of every method and
    setting, all folds in one job."""
    lab = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    folds = stratified_folds(lab, k, seed).select("id", "fold")
    s = folds_setup(spark, sf_dir, folds, list(range(k)), settings)
    m = E.macro(grid_per_class(s.gold, written(s.predict(methods), "folds-predictions")), "method", "key")
    parts = F.split("key", "[|]")
    return m.select("method", parts[0].alias("setting"), parts[1].cast("int").alias("fold"), "precision", "recall", "f1")


def fit_distant_nb(s: DistantSetup, alpha: float = 0.001):
    train_y = s.desc_w.select("id").distinct().withColumn("label", F.col("id"))
    return M.fit_multinomial_nb(s.desc_w, M.first_label(train_y), s.vocab_size, alpha)


def score_texts(s: DistantSetup, texts: DataFrame, id_col: str, text_col: str, stop_sets: str = "ce",
                alpha: float = 0.001) -> DataFrame:
    """Score arbitrary text rows (chunks, turns) with the distant NB model:
    (id, label, jll, score)."""
    from ..operators.vectorize import term_counts as tc
    classes, model = fit_distant_nb(s, alpha)
    x = weighted(tc(texts, id_col, text_col, stopword_list(stop_sets), only=s.terms), s.vocab)
    ids = texts.select(F.col(id_col).alias("id"))
    return M.score_linear_sparse(ids, x, classes, model, raw=True)


def turn_scores(spark: SparkSession, sf_dir: str, t: float = 0.1) -> DataFrame:
    """Conversation turns as chunks, scored by the distant NB model:
    (conv_id, turn, label, pred, score)."""
    s = distant_setup(spark, sf_dir)
    conv = table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("tid"), "text")
    sc = score_texts(s, conv, "tid", "text")
    return sc.select(F.split_part("id", F.lit(":"), F.lit(1)).cast("bigint").alias("conv_id"),
                     F.split_part("id", F.lit(":"), F.lit(2)).cast("bigint").alias("turn"),
                     "label", (F.col("score") > t).alias("pred"), "score")
