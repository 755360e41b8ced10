"""Evaluation (E01-E15) over long tables gold(id, label) and pred(id, label, pred[, score])."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import dealt
from .scan import running


def confusion_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Per label tp/fp/fn from gold (id,label) and predicted (id,label) sets.
    Union + two aggregations (no join): (id,label) flags, then per label sums."""
    g = gold.select("id", "label", F.lit(1).alias("g"), F.lit(0).alias("p"))
    p = pred.select("id", "label", F.lit(0).alias("g"), F.lit(1).alias("p"))
    cell = g.unionByName(p).groupBy("id", "label").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return cell.groupBy("label").agg(
        F.sum(F.col("g") * F.col("p")).cast("bigint").alias("tp"),
        F.sum((1 - F.col("g")) * F.col("p")).cast("bigint").alias("fp"),
        F.sum(F.col("g") * (1 - F.col("p"))).cast("bigint").alias("fn"))


def prf(counts: DataFrame, keep_no_gold: bool = False) -> DataFrame:
    """E01 (and E09 with ``keep_no_gold``): precision/recall/F1, zero_division=0;
    classes without gold support dropped unless asked otherwise."""
    c = counts if keep_no_gold else counts.filter(F.col("tp") + F.col("fn") > 0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    keys = [k for k in c.columns if k not in ("label", "tp", "fp", "fn")]
    return c.select(
        *keys, "label", "tp", "fp", "fn", (tp + fn).alias("support"),
        F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0)).alias("precision"),
        F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(0.0)).alias("recall"),
        F.coalesce((2 * tp) / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0)).alias("f1"))


def per_class(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """E01."""
    return prf(confusion_counts(gold, pred.filter("pred") if "pred" in pred.columns else pred))


def macro(per_class_df: DataFrame, *keys: str) -> DataFrame:
    """Macro average of P/R/F1 over the kept classes (optionally per key)."""
    aggs = [F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")]
    return per_class_df.groupBy(*keys).agg(*aggs) if keys else per_class_df.agg(*aggs)


def evaluate(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """E01+E02: one row (precision, recall, f1)."""
    return macro(per_class(gold, pred))


def report(gold: DataFrame, pred: DataFrame, ids: DataFrame) -> DataFrame:
    """Micro / macro / weighted / samples averages (classes with gold only;
    every evaluated document counts in the samples average)."""
    pc = per_class(gold, pred)
    kept = pc.select("label")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    micro = pc.agg(F.lit("micro").alias("average"),
                   F.coalesce(F.sum(tp) / F.nullif(F.sum(tp + fp), F.lit(0)), F.lit(0.0)).alias("precision"),
                   F.coalesce(F.sum(tp) / F.nullif(F.sum(tp + fn), F.lit(0)), F.lit(0.0)).alias("recall"),
                   F.coalesce(2 * F.sum(tp) / F.nullif(F.sum(2 * tp + fp + fn), F.lit(0)), F.lit(0.0)).alias("f1"))
    mac = macro(pc).select(F.lit("macro").alias("average"), "precision", "recall", "f1")
    sup = F.col("support")
    wei = pc.agg(F.lit("weighted").alias("average"),
                 (F.sum(F.col("precision") * sup) / F.sum(sup)).alias("precision"),
                 (F.sum(F.col("recall") * sup) / F.sum(sup)).alias("recall"),
                 (F.sum(F.col("f1") * sup) / F.sum(sup)).alias("f1"))
    g = gold.join(kept, "label").select("id", "label", F.lit(1).alias("g"), F.lit(0).alias("p"))
    p = (pred.filter("pred") if "pred" in pred.columns else pred).join(kept, "label") \
        .select("id", "label", F.lit(0).alias("g"), F.lit(1).alias("p"))
    cell = g.unionByName(p).groupBy("id", "label").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    d = cell.groupBy("id").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum("g").alias("ng"), F.sum("p").alias("np"))
    d = ids.select("id").distinct().join(d, "id", "left").na.fill(0, ["tp", "ng", "np"])
    samp = d.agg(F.lit("samples").alias("average"),
                 F.avg(F.coalesce(F.col("tp") / F.nullif(F.col("np"), F.lit(0)), F.lit(0.0))).alias("precision"),
                 F.avg(F.coalesce(F.col("tp") / F.nullif(F.col("ng"), F.lit(0)), F.lit(0.0))).alias("recall"),
                 F.avg(F.coalesce(2 * F.col("tp") / F.nullif(F.col("ng") + F.col("np"), F.lit(0)), F.lit(0.0))).alias("f1"))
    return micro.unionByName(mac).unionByName(wei).unionByName(samp)


def roc_auc(gold: DataFrame, scores: DataFrame, ids: DataFrame) -> DataFrame:
    """One-vs-rest ROC-AUC per label by the rank-sum (Mann-Whitney) formula
    with average ranks for ties. Documents without a score row count as score 0.

    Skew-safe ranking: scores first collapse to (label, score) rows with
    positive/negative counts; those rows are dealt by ranges of (label, score) and their counts
    summed up block by block (``scan.running``), however scores pile up. Output (label, n_pos, n_neg, auc); auc is null for a one-sided label."""
    n_docs = ids.select("id").distinct().count()
    g = gold.select("id", "label").distinct().withColumn("y", F.lit(1))
    s = scores.select("id", "label", F.col("score").cast("double").alias("score"))
    j = s.join(g, ["id", "label"], "full_outer").select(
        "label", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("y", F.lit(0)).alias("y"))
    col = j.groupBy("label", "score").agg(F.sum("y").alias("np_"), F.count(F.lit(1)).alias("n"))
    tot = col.groupBy("label").agg(F.sum("np_").alias("P"), F.sum("n").alias("scored"))
    # rows missing entirely (doc never scored nor gold for the label): score 0, negative
    miss = tot.select("label", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("np_"),
                      (F.lit(n_docs) - F.col("scored")).alias("n")).filter(F.col("n") > 0)
    col = col.unionByName(miss).groupBy("label", "score").agg(F.sum("np_").alias("np_"), F.sum("n").alias("n"))
    c = running(col, ["label"], ["score"], {"upto": F.col("n")})
    c = c.withColumn("avg_rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0)
    r = c.groupBy("label").agg(F.sum(F.col("np_") * F.col("avg_rank")).alias("rs"), F.sum("np_").alias("n_pos"),
                               F.sum("n").alias("n_all"))
    r = r.withColumn("n_neg", F.col("n_all") - F.col("n_pos")).filter(F.col("n_pos") > 0)
    auc = (F.col("rs") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / (F.col("n_pos") * F.col("n_neg"))
    return r.select("label", F.col("n_pos").cast("bigint"), F.col("n_neg").cast("bigint"),
                    F.when(F.col("n_neg") > 0, auc).alias("auc"))


def macro_auc(auc: DataFrame) -> DataFrame:
    """E04 macro: mean over labels with both classes present."""
    return auc.filter(F.col("auc").isNotNull()).agg(F.avg("auc").alias("auc"))


def first_label_confusion(gold: DataFrame, pred: DataFrame, ids: DataFrame) -> DataFrame:
    """Confusion table of the first (smallest) gold label vs the first
    predicted label per document (null when a side is empty)."""
    g = gold.groupBy("id").agg(F.min("label").alias("gold"))
    p = (pred.filter("pred") if "pred" in pred.columns else pred).groupBy("id").agg(F.min("label").alias("pred"))
    d = ids.select("id").distinct().join(g, "id", "left").join(p, "id", "left")
    return d.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def binary_confusion(gold: DataFrame, pred: DataFrame, n_docs: int) -> DataFrame:
    """Per label tn/fp/fn/tp over all (document, label) cells; tn from the
    document count, so the dense cell grid is never built."""
    c = confusion_counts(gold, pred.filter("pred") if "pred" in pred.columns else pred)
    return c.select("label", (F.lit(n_docs) - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"), "fp", "fn", "tp")


def specificity(confusion: DataFrame) -> DataFrame:
    """Per label, among documents whose first gold label is another label,
    the share whose first predicted label is not this label (from E06)."""
    n, gold, pred = F.col("n"), F.col("gold"), F.col("pred")
    total = confusion.agg(F.sum("n").alias("all"))
    own = confusion.filter(gold.isNotNull()).groupBy(gold.alias("label")).agg(
        F.sum("n").alias("own"), F.sum(F.when(pred == gold, n).otherwise(0)).alias("hit"))
    named = confusion.filter(pred.isNotNull()).groupBy(pred.alias("label")).agg(F.sum("n").alias("named"))
    all_docs = total.first()["all"]
    neg = F.lit(all_docs) - F.col("own")
    false = F.coalesce("named", F.lit(0)) - F.col("hit")
    return own.join(named, "label", "left").filter(neg > 0).select("label", ((neg - false) / neg).alias("specificity"))


def majority_baseline(doc_labels: DataFrame, n_classes: int | None = None) -> DataFrame:
    """Predict the majority class for everyone: recall 1 for it, precision =
    its share; every other class scores 0; mean F1 over the class count."""
    from .aggregate import majority_class
    m = majority_class(doc_labels)
    c = n_classes or doc_labels.select("label").distinct().count()
    f1 = 2 * F.col("share") / (1 + F.col("share"))
    return m.select("label", F.col("share").alias("precision"), F.lit(1.0).alias("recall"),
                    (f1 / F.lit(c)).alias("f1_macro"))


def per_rep_macro(cells: DataFrame, key: str = "rep") -> DataFrame:
    """Macro P/R/F1 per replicate key of cells (key, label, g, p), one per (key, document, label); cells that are
    neither gold nor predicted may be there. Sums go by (key, label) within tasks: no cell is shuffled."""
    n = F.col("n")
    cnt = cells.groupBy(key, "label", "g", "p").agg(F.count(F.lit(1)).alias("n")).groupBy(key, "label").agg(
        F.sum(n * F.col("g") * F.col("p")).alias("tp"), F.sum(n * (1 - F.col("g")) * F.col("p")).alias("fp"),
        F.sum(n * F.col("g") * (1 - F.col("p"))).alias("fn"))
    return macro(prf(cnt), key)


#: Most rows whose draws a task counts in one array; draws it hashes at once; rows of a packed block of outcomes;
#: most kinds of outcomes, and groups of replicates, of a tally.
COUNTED, AT_ONCE, PACKED, KINDS, PARTS = 1 << 23, 1 << 15, 1 << 16, 1 << 16, 128


def _drawn(seed, rep: int, n: int):
    """The indexes that replicate ``rep`` draws, a piece at a time."""
    from ..functions.hashing import hashes_of_numbers
    for lo in range(0, n, AT_ONCE):
        yield hashes_of_numbers(f"{seed}|{rep}|", lo, min(n, lo + AT_ONCE)) % n


def bootstrap_draws(spark, n: int, reps: int, seed=0) -> "DataFrame":
    """X06 (exact): replicate r draws n row indexes with replacement,
    idx = h(seed, r, j) mod n; returned as multiplicities (rep, idx, w).

    A replicate of up to COUNTED rows is drawn and counted in one task, so that no draw is shuffled; draws of
    longer ones are summed by Spark."""
    from ..functions.hashing import stable_hash
    if 0 < n <= COUNTED:
        def run(batches):
            import numpy as np
            import pyarrow as pa
            for b in batches:
                for rep in b.column("rep").to_pylist():
                    w = np.zeros(n, np.int64)
                    for idx in _drawn(seed, rep, n):
                        np.add.at(w, idx, 1)
                    for lo in range(0, n, PACKED):
                        part = w[lo:lo + PACKED]
                        at = np.flatnonzero(part)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), rep, np.int64)), pa.array(at + lo), pa.array(part[at])], names=["rep", "idx", "w"])
        return spark.range(0, reps, 1, min(reps, 2 * PARTS)).select(F.col("id").alias("rep")).mapInArrow(run, "rep long, idx long, w long")
    d = spark.range(reps * n).select(F.floor(F.col("id") / n).cast("bigint").alias("rep"), F.pmod("id", F.lit(n)).alias("j"))
    d = d.select("rep", (stable_hash(seed, "rep", "j") % n).alias("idx"))
    return d.groupBy("rep", "idx").agg(F.count(F.lit(1)).alias("w"))


def _tallied(outcome: DataFrame, kinds: DataFrame, size: int, n: int, reps: int, seed) -> DataFrame:
    """(rep, kind, w): how often each replicate draws rows of each of ``size`` kinds; ``outcome`` is (idx, o), ``kinds``
    (o, kind). Rows' kinds go packed (4 bytes a row) to every group of replicates, which draw and count there."""
    from .scan import written

    def pack(key, t):
        import numpy as np
        import pyarrow as pa
        codes = np.full(PACKED, size, np.int32)
        codes[t.column("idx").to_numpy() % PACKED] = t.column("kind").to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "codes": pa.array([codes.tobytes()], pa.binary())})

    def tally(key, t):
        import numpy as np
        import pyarrow as pa
        codes = np.full(-(-n // PACKED) * PACKED, size, np.int32)
        for block, packed in zip(t.column("block").to_pylist(), t.column("codes")):
            codes[block * PACKED:(block + 1) * PACKED] = np.frombuffer(packed.as_buffer(), np.int32)
        out = []
        for rep in range(key[0].as_py(), reps, parts):
            w = np.zeros(size + 1, np.int64)
            for idx in _drawn(seed, rep, n):
                w += np.bincount(codes[idx], minlength=size + 1)
            at = np.flatnonzero(w[:size])
            out.append(pa.table({"rep": pa.array(np.full(len(at), rep, np.int64)), "kind": pa.array(at), "w": pa.array(w[at])}))
        return pa.concat_tables(out)
    parts = min(reps, PARTS)
    block = F.floor(F.col("idx") / PACKED).cast("bigint").alias("block")
    blocks = written(outcome.join(kinds, "o").select(block, "idx", "kind").groupBy("block").applyInArrow(pack, "block long, codes binary"), "outcome-kinds")
    copies = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return dealt(copies, "part").groupBy("part").applyInArrow(tally, "rep long, kind long, w long")


def bootstrap_sums(cells: DataFrame, n: int, reps: int, seed, *keys: str) -> DataFrame:
    """(rep, keys..., label, tp, fp, fn) of :func:`bootstrap_cells` over the draws of :func:`bootstrap_draws`, for cells
    (idx, keys..., label, g, p). Few kinds of outcomes are tallied where they are drawn: no draw is shuffled."""
    from ..functions.hashing import stable_hash
    from .sample import grouped_rank
    from .scan import written
    outcome = cells.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct(*keys, "label", "g", "p"))).alias("cells"))
    outcome = written(outcome.withColumn("o", F.to_json(F.struct("cells"))), "outcomes")
    kinds = outcome.groupBy("o").agg(F.first("cells").alias("cells")).withColumn("_h", stable_hash(seed, "o"))
    kinds = written(grouped_rank(kinds, [], "_h", "o").select((F.col("rn") - 1).cast("int").alias("kind"), "o", "cells"), "kinds")
    size = kinds.count()
    if 0 < n <= COUNTED and 0 < size <= KINDS:
        per = _tallied(outcome.select("idx", "o"), kinds.select("o", "kind"), size, n, reps, seed).join(kinds, "kind")
    else:
        per = bootstrap_draws(cells.sparkSession, n, reps, seed).join(outcome, "idx").groupBy("rep", "cells").agg(F.sum("w").alias("w"))
    j = per.select("rep", "w", F.inline("cells"))
    return j.groupBy("rep", *keys, "label").agg(
        F.sum(F.col("w") * F.col("g") * F.col("p")).alias("tp"),
        F.sum(F.col("w") * (1 - F.col("g")) * F.col("p")).alias("fp"),
        F.sum(F.col("w") * F.col("g") * (1 - F.col("p"))).alias("fn"))


#: Children of a node of the splitting tree.
FAN = 256


def multinomial_outcomes(outcomes: DataFrame, reps: int, seed=0) -> DataFrame:
    """X06 over distinct outcomes: rows (o, m) of an outcome and its number of documents give
    (rep, o, w): how often replicate ``rep`` draws it, with n = sum of m draws with replacement.

    The draws of a node are split among its children by conditional binomials, from the
    whole down to single outcomes, so a replicate costs its outcomes and not its n draws; no
    table has n rows. Generators are seeded by (seed, replicate, node): reruns agree."""
    from functools import partial

    import numpy as np

    from ..functions.hashing import stable_hash
    from .sample import grouped_rank
    from .scan import written
    h = outcomes.groupBy("o").agg(F.sum("m").alias("m")).filter("m > 0").withColumn("_h", stable_hash(seed, "o"))
    leaves = written(grouped_rank(h, [], "_h", "o").select((F.col("rn") - 1).alias("node"), "o", "m"), "outcomes")
    size, depth = leaves.count(), 1
    while FAN ** depth < size:
        depth += 1
    levels = [leaves.select("node", "m")]
    for _ in range(depth):
        levels.append(levels[-1].groupBy(F.floor(F.col("node") / FAN).cast("bigint").alias("node")).agg(F.sum("m").alias("m")))

    def split(batches, level):
        import pyarrow as pa
        for b in batches:
            reps_, nodes, counts = [], [], []
            for rep, node, w, kids in zip(*(b.column(c).to_pylist() for c in ("rep", "node", "w", "kids"))):
                rng = np.random.Generator(np.random.Philox(key=[(int(seed) << 32) ^ rep, (node << 8) ^ level]))
                kids = sorted((k["node"], k["m"]) for k in kids)
                left = sum(m for _, m in kids)
                for child, m in kids:
                    drawn = int(rng.binomial(w, m / left)) if m < left else w
                    left -= m
                    w -= drawn
                    if drawn:
                        reps_.append(rep)
                        nodes.append(child)
                        counts.append(drawn)
            yield pa.RecordBatch.from_arrays([pa.array(reps_, pa.int64()), pa.array(nodes, pa.int64()), pa.array(counts, pa.int64())], names=["rep", "node", "w"])
    drawn = levels[-1].select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(reps - 1).cast("bigint"))).alias("rep"), F.col("node").cast("bigint"), F.col("m").cast("bigint").alias("w"))
    for at in reversed(range(depth)):
        kids = levels[at].groupBy(F.floor(F.col("node") / FAN).cast("bigint").alias("node")).agg(
            F.collect_list(F.struct(F.col("node").cast("bigint").alias("node"), F.col("m").cast("bigint").alias("m"))).alias("kids"))  # FAN at most
        drawn = drawn.repartition("rep").join(kids, "node").mapInArrow(partial(split, level=at), "rep long, node long, w long")
    return drawn.join(leaves.select("node", "o"), "node").select("rep", "o", "w")


def bootstrap_metrics(gold: DataFrame, pred: DataFrame, ids: DataFrame, reps: int, seed=0) -> DataFrame:
    """E12 over distinct outcomes: (rep, precision, recall, f1). Documents with the same gold and predicted
    labels are interchangeable; those with neither count as draws too."""
    g = gold.select("id", "label", F.lit(1).alias("g"), F.lit(0).alias("p"))
    p = (pred.filter("pred") if "pred" in pred.columns else pred).select("id", "label", F.lit(0).alias("g"), F.lit(1).alias("p"))
    cell = g.unionByName(p).groupBy("id", "label").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    doc = cell.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("label", "g", "p"))).alias("cells"))
    kinds = ids.select("id").distinct().join(doc, "id", "left").groupBy("cells").agg(F.count(F.lit(1)).alias("m"))
    kinds = kinds.withColumn("o", F.coalesce(F.to_json(F.struct("cells")), F.lit("{}")))
    w = multinomial_outcomes(kinds.select("o", "m"), reps, seed)
    j = w.join(kinds.select("o", "cells"), "o").select("rep", "w", F.inline("cells"))
    counts = j.groupBy("rep", "label").agg(F.sum(F.col("w") * F.col("g") * F.col("p")).alias("tp"), F.sum(F.col("w") * (1 - F.col("g")) * F.col("p")).alias("fp"),
                                           F.sum(F.col("w") * F.col("g") * (1 - F.col("p"))).alias("fn"))
    return macro(prf(counts), "rep")


def bootstrap_cells(cells: DataFrame, draws: DataFrame) -> DataFrame:
    """Weighted per-replicate tp/fp/fn per label from per-document cells
    (idx, label, g, p) and draw multiplicities (rep, idx, w). Documents with the same cells
    are interchangeable: draws are summed per replicate and outcome before cells come back."""
    outcome = cells.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("label", "g", "p"))).alias("cells"))
    per = draws.join(outcome, "idx").groupBy("rep", "cells").agg(F.sum("w").alias("w"))
    j = per.select("rep", "w", F.inline("cells"))
    return j.groupBy("rep", "label").agg(
        F.sum(F.col("w") * F.col("g") * F.col("p")).alias("tp"),
        F.sum(F.col("w") * (1 - F.col("g")) * F.col("p")).alias("fp"),
        F.sum(F.col("w") * F.col("g") * (1 - F.col("p"))).alias("fn"))


def confidence_interval(rep_metrics: DataFrame, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """E12 tail: linear-interpolated percentiles of per-replicate macro metrics."""
    names = ("precision", "recall", "f1")
    one = rep_metrics.agg(*[F.percentile(m, F.lit(q)).alias(f"{m}_{end}") for m in names for end, q in (("lo", lo), ("hi", hi))])  # replicates are made once
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_lo").alias("lo"), F.col(f"{m}_hi").alias("hi")) for m in names])))


def doc_cells(gold: DataFrame, pred: DataFrame, ids: DataFrame, seed=29) -> DataFrame:
    """Per evaluated document a dense index 0..n-1 (hash order, numbered with the
    skew-safe bucketed rank, no single-partition window) and its (label, g, p)
    cells; used by the bootstrap."""
    from ..functions.hashing import stable_hash
    from .sample import grouped_rank
    h = ids.select("id").distinct().withColumn("_h", stable_hash(seed, "id"))
    idx = grouped_rank(h, [], "_h", "id").select("id", (F.col("rn") - 1).alias("idx"))
    g = gold.select("id", "label", F.lit(1).alias("g"), F.lit(0).alias("p"))
    p = (pred.filter("pred") if "pred" in pred.columns else pred).select("id", "label", F.lit(0).alias("g"), F.lit(1).alias("p"))
    cell = g.unionByName(p).groupBy("id", "label").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return cell.join(idx, "id").select("idx", "label", "g", "p")


def masked_accuracy(rows: DataFrame) -> DataFrame:
    """Share of positions with prediction == target, ignoring target -100."""
    return rows.filter(F.col("target") != -100).agg(
        F.avg((F.col("pred") == F.col("target")).cast("double")).alias("accuracy"))


def poisson_weight(u) -> "F.Column":
    """Poisson(1) variate from a uniform in [0,1) by inverse CDF (k <= 12; the
    tail beyond has probability < 1e-9 and is folded into 12)."""
    import math
    cdf, acc = [], 0.0
    for k in range(13):
        acc += math.exp(-1.0) / math.factorial(k)
        cdf.append(acc)
    expr = F.lit(12)
    for k in range(11, -1, -1):
        expr = F.when(u < F.lit(cdf[k]), F.lit(k)).otherwise(expr)
    return expr


def poisson_weight_of_digest(digest) -> "F.Column":
    """:func:`poisson_weight` of the uniform that a digest's first 15 hexadecimal digits stand for: they are compared
    as text with the smallest digest of each weight, so that no number is parsed and the digest is made once."""
    from ..functions.hashing import HASH_BITS
    reached = None
    for lo in poisson_bounds():
        step = (digest >= F.lit(format(lo, f"0{HASH_BITS // 4}x"))).cast("int")
        reached = step if reached is None else reached + step
    return reached


def poisson_bounds() -> list:
    """The smallest hash of each weight from 1 to 12."""
    import math

    from ..functions.hashing import SPAN
    acc, out = 0.0, []
    for k in range(12):
        acc += math.exp(-1.0) / math.factorial(k)
        lo, hi = 0, SPAN
        while lo < hi:  # smallest hash whose uniform, as a double, is not below the distribution function
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if float(mid) / float(SPAN) < acc else (lo, mid)
        out.append(lo)
    return out


def poisson_bootstrap_cells(cells: DataFrame, reps: int, seed=0, key: str = "id") -> DataFrame:
    """X06 (scalable mode): every document gets an independent Poisson(1) weight
    per replicate from a hash of (seed, replicate, document) -- no global index,
    no join with a draw table; per (rep, label) weighted tp/fp/fn. A document is hashed once for all its cells, and tasks
    sum the weights by kind of cell."""
    from ..functions.hashing import key_text
    kind = cells.schema["label"].dataType
    each = cells.select(key_text(key).alias("_rest"), F.struct("label", F.col("g").cast("int").alias("g"), F.col("p").cast("int").alias("p")).alias("cell"))
    each = dealt(each.groupBy("_rest").agg(F.collect_list("cell").alias("cells")), "_rest")
    bounds = poisson_bounds()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from ..functions.hashing import hashes_of_texts
        sums: dict = {}
        of_label = None

        def out():
            for (label, g, p), w in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(range(reps), pa.int32()), pa.array([label] * reps, of_label), pa.array([g] * reps, pa.int32()),
                                                  pa.array([p] * reps, pa.int32()), pa.array(w)], names=["rep", "label", "g", "p", "w"])
        for b in batches:
            flat = b.column("cells").flatten()
            of_label = flat.field("label").type
            doc = np.repeat(np.arange(b.num_rows), b.column("cells").value_lengths().to_numpy(zero_copy_only=False))
            kinds: dict = {}
            code = np.fromiter((kinds.setdefault(x, len(kinds)) for x in zip(*(flat.field(c).to_pylist() for c in ("label", "g", "p")))), np.int64, len(flat))
            total = np.zeros((reps, len(kinds)), np.int64)
            rests = [x.encode() for x in b.column("_rest").to_pylist()]
            for rep, start, hashes in hashes_of_texts(seed, reps, rests):
                lo, hi = np.searchsorted(doc, (start, start + len(hashes)))
                w = np.searchsorted(bounds, hashes, side="right")
                total[rep] += np.bincount(code[lo:hi], weights=w[doc[lo:hi] - start], minlength=len(kinds)).astype(np.int64)
            for x, i in kinds.items():
                sums[x] = sums.get(x, 0) + total[:, i]
            if len(sums) > 4096:
                yield from out()
                sums.clear()
        yield from out()
    schema = StructType([StructField("rep", IntegerType()), StructField("label", kind), StructField("g", IntegerType()), StructField("p", IntegerType()), StructField("w", LongType())])
    x = each.mapInArrow(run, schema)
    return x.groupBy("rep", "label").agg(
        F.sum(F.col("w") * F.col("g") * F.col("p")).alias("tp"),
        F.sum(F.col("w") * (1 - F.col("g")) * F.col("p")).alias("fp"),
        F.sum(F.col("w") * F.col("g") * (1 - F.col("p"))).alias("fn"))
