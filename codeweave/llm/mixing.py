"""Mixing sources to target weights by entropy balancing.

Each document gets a rate (expected copies) as close as possible, in relative entropy, to
one copy each, such that the tokens of every source meet its target and no rate is above
``max_repeat``. The minimiser is an exponential tilt in the document's size,
``rate = min(max_repeat, exp(lambda_source * size / scale_source))``; the multipliers
solve the convex dual, one unknown per source, by Newton steps kept inside a bracket.

Rates depend on (source, size) only, so every Newton step is an aggregate over the
histogram (source, size, documents), not over documents; a hot source is pre-aggregated
map-side into at most as many rows as there are different sizes. The multipliers stay in
a DataFrame; the driver sees one number per step, the largest relative error.

Rounding: within a source, copies per size are the increments of the rounded running sum
of rates over falling sizes; a few repair steps then move single copies of the largest
size that still fits the remaining error, so that the words taken end within the smallest
size of the target wherever sizes allow. Which documents of a size get the additional copy is
decided by a hash of the id, ranked inside (size, hash bucket), so a size that a third of
all rows share is never ranked in one task.

Everything is DataFrame functions. Reruns give the same rows.

Defined cases: null or blank text has size 0 and takes nothing; a null source is a source
of its own, sorted last; null ids take part and are told apart by rank only; repeated rows are
separate documents; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, load, own_columns, stage

NEWTON_STEPS = 60
TOLERANCE = 1e-9
REPAIR_STEPS = 6
BUCKETS = 4096


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of the whole text."""
    d = own_columns(docs, doc_id=("doc_id", "long"), source=("source", "string"), text=("text", "string"))
    return d.select("doc_id", "source",
                    F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def weighted_targets(sizes: DataFrame, weights=(5, 2, 1), total_share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, n_docs, source_size, target): sources by code point, null last, weigh
    ``weights`` in turn and share ``total_share`` of all sizes; targets stop at ``cap``
    times the source's size and the excess is shared by weight again. The fixed point
    is closed form: in order of size per weight the first sources are full, and the
    others split what is left. One row per source; no document is in this table."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    k = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(k)) + 1).cast("int"))
    t = src.withColumn("w", w).withColumn("room", F.col("source_size") * F.lit(float(cap)))
    up = Window.orderBy(F.col("room") / F.col("w"), F.col("source").isNull(), "source")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = (t.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(total_share)))
         .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
         .withColumn("room_before", F.coalesce(F.sum("room").over(before), F.lit(0.0)))
         .withColumn("level", (F.col("total") - F.col("room_before")) / F.col("w_left"))
         .withColumn("full", F.col("level") * F.col("w") >= F.col("room")))
    # the first source that is not full sets the level of all later ones
    open_level = F.min(F.when(~F.col("full"), F.struct((F.col("room") / F.col("w")).alias("r"), F.col("source").isNull().alias("z"),
                                                        F.col("source").alias("s"), F.col("level").alias("level")))).over(everything)
    t = t.withColumn("open_level", open_level["level"])
    target = F.least(F.col("room"), F.coalesce(F.col("w") * F.col("open_level"), F.col("room")))
    return t.select("source", "n_docs", "source_size", target.alias("target"))


def balance(hist: DataFrame, targets: DataFrame, max_repeat: float = 2.0,
            steps: int = NEWTON_STEPS, tol: float = TOLERANCE) -> DataFrame:
    """(source, lam, scale): multipliers whose tilted rates meet the targets.

    The dual gradient of a source is sum(n * size * rate) - target, its curvature the same
    sum over rates below the bound times size. Newton works on the logarithm of the
    gradient's first term; a step that leaves the bracket is replaced by its middle."""
    ok = F.col("source_size") > 0
    full = F.col("target") >= F.col("source_size") * F.lit(max_repeat) * F.lit(1 - 1e-12)
    base = targets.select("source", "source_size", "target", (F.col("source_size") / F.col("n_docs")).alias("scale"),
                          full.alias("full")).filter(ok & (F.col("target") > 0))
    h = stage(hist.join(base.select(F.col("source").alias("s"), "scale", "target"),
                        F.col("source").eqNullSafe(F.col("s")))
              .filter("size > 0").select("source", "n", "size", "target", "scale", (F.col("size") / F.col("scale")).alias("x")), "balance")
    # every size is at least x_min of its source: beyond log(max_repeat)/x_min all rates are at the bound
    bound = h.groupBy("source").agg((F.log(F.lit(float(max_repeat))) / F.min("x")).alias("top"))
    lam = stage(base.join(bound.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "scale", "target", "full",
        F.when(F.col("full"), F.col("top")).otherwise(0.0).alias("lam"),
        F.lit(None).cast("double").alias("lo"), F.when(F.lit(True), F.col("top")).alias("hi")), "lambda")
    for _ in range(steps):
        rate = F.least(F.lit(float(max_repeat)), F.exp(F.least(F.col("lam") * F.col("x"), F.lit(50.0))))
        inside = F.col("lam") * F.col("x") < F.log(F.lit(float(max_repeat)))
        s = (h.join(lam.filter(~F.col("full")).select(F.col("source").alias("s"), "lam"), F.col("source").eqNullSafe(F.col("s")))
             .groupBy("source").agg(F.sum(F.col("n") * F.col("size") * rate).alias("g"),
                                    F.sum(F.when(inside, F.col("n") * F.col("size") * F.col("x") * rate).otherwise(0.0)).alias("c")))
        j = lam.join(s.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        err = F.col("g") / F.col("target") - 1
        lo = F.when(err < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(err > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.log(F.col("g") / F.col("target")) * F.col("g") / F.col("c")
        # below any bracket the step doubles downwards, inside it the middle is taken
        safe = F.when((F.col("c") > 0) & (F.col("g") > 0) & ((F.col("lo_").isNull()) | (newton > F.col("lo_"))) & (newton < F.col("hi_")), newton) \
            .when(F.col("lo_").isNull(), F.least(F.col("lam") * 2, F.col("lam") - 1.0)).otherwise((F.col("lo_") + F.col("hi_")) / 2)
        j = j.withColumn("lo_", lo).withColumn("hi_", hi)
        lam = stage(j.select("source", "scale", "target", "full",
                             F.when(F.col("full") | (F.abs(err) <= tol) | F.col("g").isNull(), F.col("lam")).otherwise(safe).alias("lam"),
                             F.col("lo_").alias("lo"), F.col("hi_").alias("hi"),
                             F.when(F.col("full"), 0.0).otherwise(F.abs(err)).alias("err")), "lambda")
        worst = lam.agg(F.max("err")).first()[0]
        lam = lam.drop("err")
        if worst is None or worst <= tol:
            break
    return lam.select("source", "lam", "scale", "full")


def copies_per_size(hist: DataFrame, targets: DataFrame, lam: DataFrame, max_repeat: int = 2) -> DataFrame:
    """(source, size, n, copies): integer copies of each size's documents, 0 to max_repeat * n."""
    h = hist.join(targets.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    h = h.join(lam.select(F.col("source").alias("s"), "lam", "scale", "full"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("lam").isNull(), 0.0).when(F.col("full"), F.lit(float(max_repeat))).otherwise(
        F.least(F.lit(float(max_repeat)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0)))))
    run = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source")
    limit = F.col("n") * F.lit(max_repeat)
    h = h.withColumn("cum", F.sum(F.col("n") * rate).over(run))
    h = h.withColumn("upto", F.floor(F.col("cum") + 0.5))
    before = F.lag("upto").over(Window.partitionBy("source").orderBy(F.col("size").desc()))
    h = h.withColumn("copies", F.greatest(F.lit(0), F.least(limit, F.col("upto") - F.coalesce(before, F.lit(0)))).cast("long"))
    for _ in range(REPAIR_STEPS):
        gap = F.col("gap")
        h = h.withColumn("gap", F.first("target").over(whole) - F.sum(F.col("copies") * F.col("size")).over(whole))
        room = F.when(gap > 0, limit - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs(gap)) & (room > 0)
        h = h.withColumn("pick", F.max(F.when(fits, F.col("size"))).over(whole))
        move = F.least(room, F.floor(F.abs(gap) / F.col("size"))) * F.when(gap > 0, 1).otherwise(-1)
        h = h.withColumn("copies", F.when(F.col("size") == F.col("pick"), F.col("copies") + move).otherwise(F.col("copies")).cast("long"))
    return h.select("source", "size", "n", "copies")


def mix(docs: DataFrame, weights=(5, 2, 1), total_share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """All documents with doc_id, source, size, source_size, target, rate, copies, taken."""
    sizes = stage(document_sizes(docs).withColumn(
        "h", F.xxhash64(F.lit("mix"), "doc_id")).withColumn("b", F.pmod("h", F.lit(BUCKETS)).cast("int")), "sizes")
    hist = stage(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    per_source = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("size"), F.sum("n").alias("n"))
    targets = stage(_targets_from(per_source, weights, total_share, max_repeat), "targets")
    lam = balance(hist, targets, max_repeat)
    plan = stage(copies_per_size(hist, targets, lam, max_repeat)
                 .withColumn("each", F.floor(F.col("copies") / F.col("n")).cast("int"))
                 .withColumn("extra", F.col("copies") - F.col("each") * F.col("n")), "copies")
    # documents of one size are interchangeable: `extra` of them, in hash order, get one copy more
    some = plan.filter("extra > 0").select(F.col("source").alias("s"), F.col("size").alias("z"), "extra")
    keyed = sizes.join(some, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    counts = keyed.groupBy("s", "z", "b").agg(F.count(F.lit(1)).alias("c"), F.first("extra").alias("extra"))
    upto = F.sum("c").over(Window.partitionBy("s", "z").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    quota = counts.withColumn("quota", F.greatest(F.lit(0), F.least(F.col("c"), F.col("extra") - (upto - F.col("c")))))
    quota = quota.filter("quota > 0").select("s", "z", "b", "quota", (F.col("quota") == F.col("c")).alias("whole"))
    full = quota.filter("whole").select(F.col("s").alias("qs"), F.col("z").alias("qz"), F.col("b").alias("qb"))
    part = quota.filter(~F.col("whole")).select(F.col("s").alias("qs"), F.col("z").alias("qz"), F.col("b").alias("qb"), "quota")
    on = F.col("source").eqNullSafe(F.col("qs")) & (F.col("size") == F.col("qz")) & (F.col("b") == F.col("qb"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "b").orderBy("h", "doc_id"))
    near = sizes.join(part, on).drop("qs", "qz", "qb").withColumn("more", (rank <= F.col("quota")).cast("int")).drop("quota")
    rest = (sizes.join(part, on, "left_anti").join(full.withColumn("more", F.lit(1)), on, "left")
            .drop("qs", "qz", "qb").withColumn("more", F.coalesce("more", F.lit(0))))
    d = rest.unionByName(near)
    d = d.join(plan.select(F.col("source").alias("ps"), F.col("size").alias("pz"), "each"),
               F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz")))
    d = d.join(targets.select(F.col("source").alias("ts"), "source_size", "target"), F.col("source").eqNullSafe(F.col("ts")))
    copies = F.col("each") + F.col("more")
    return d.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                    (copies * F.col("size")).cast("long").alias("taken"))


def _targets_from(per_source: DataFrame, weights, total_share, cap) -> DataFrame:
    """weighted_targets from one row a source (its size and documents)."""
    t = weighted_targets(per_source.select("source", "size"), weights, total_share, float(cap))
    n = per_source.select(F.col("source").alias("s"), "n")
    return t.drop("n_docs").join(n, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", F.col("n").alias("n_docs"), "source_size", "target")


def op2_mixing(spark, sf_dir):
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op2_mixing": op2_mixing}
ORACLES = {}
