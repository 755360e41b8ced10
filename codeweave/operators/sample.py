"""Sampling and splits (X01-X11) with hash-based deterministic randomness.

Exact per-group numbering never puts a whole group into one task: rows are
bucketed by the leading bits of their hash, bucket sizes are counted (a small
table), prefix sums give each bucket's offset, and ``row_number`` runs inside
(group, bucket) only.  A group holding a third of all rows is spread over
``2**bucket_bits`` tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import HASH_BITS, key_text, stable_bit, stable_hash, unit_uniform
from ..session import bounded_rows, dealt
from ..sources.io import scratch_path

BUCKET_BITS = 12


def grouped_rank(df: DataFrame, group_cols: list, h: str, tie: str,
                 bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Adds ``rn`` (1-based order of (h, tie) inside the group) and ``grp_n``
    (group size).  ``h`` must be a :func:`stable_hash` column."""
    b = df.withColumn("_bkt", F.shiftright(F.col(h), HASH_BITS - bucket_bits))
    keys = list(group_cols) + ["_bkt"]
    cnt = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    wg = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    offs = cnt.select(
        *keys,
        (F.sum("_c").over(wg.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
        F.sum("_c").over(wg).alias("grp_n"))
    j = b.join(offs, keys)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(h), F.col(tie)))
    return j.withColumn("rn", rn + F.coalesce(F.col("_off"), F.lit(0))).drop("_bkt", "_off")


def split_cutoffs(df: DataFrame, group_cols: list, key: str, fraction: float, seed=0,
                  bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """One row per group: (group columns, cut_h, cut_key), the hash and key of its row number
    ceil(fraction * n) in hash order. Bucket counts say which bucket holds that row, and only
    the rows of that one bucket are ranked; no row is joined back."""
    b = df.select(*group_cols, key).withColumn("_h", stable_hash(seed, key)) \
        .withColumn("_bkt", F.shiftright("_h", HASH_BITS - bucket_bits))
    cnt = b.groupBy(*group_cols, "_bkt").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group_cols)
    cum = F.sum("_c").over(w.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, 0))
    at = (cnt.withColumn("_upto", cum).withColumn("_k", F.ceil(F.sum("_c").over(w) * F.lit(fraction)))
          .filter((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_c") < F.col("_k")))
          .select(*group_cols, "_bkt", (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_nth")))
    rn = F.row_number().over(Window.partitionBy(*group_cols, "_bkt").orderBy("_h", key))
    return (b.join(at, [*group_cols, "_bkt"]).withColumn("_rn", rn).filter(F.col("_rn") == F.col("_nth"))
            .select(*group_cols, F.col("_h").alias("cut_h"), F.col(key).alias("cut_key")))


def written_cutoffs(df: DataFrame, group_cols: list, key: str, fraction: float, seed=0,
                    bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """:func:`split_cutoffs` written to the shared folder, so that its true size decides how it is joined."""
    path = scratch_path(df.sparkSession, "cutoffs")
    split_cutoffs(df, group_cols, key, fraction, seed, bucket_bits).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def group_split(df: DataFrame, group_cols: list, key: str, fraction: float, seed=0, cutoffs: DataFrame | None = None) -> DataFrame:
    """Per group, the first ceil(fraction*n) rows in hash order go to the
    test side (``is_test``); the rest are train. Rows only meet the one-row-per-group
    table of cutoffs: wide rows (texts) are not shuffled to get the flag."""
    cut = cutoffs if cutoffs is not None else written_cutoffs(df, group_cols, key, fraction, seed)
    h = df.withColumn("_h", stable_hash(seed, key)).join(cut, group_cols)
    first = (F.col("_h") < F.col("cut_h")) | ((F.col("_h") == F.col("cut_h")) & (F.col(key) <= F.col("cut_key")))
    return h.withColumn("is_test", first).drop("_h", "cut_h", "cut_key")


def multilabel_strata(doc_labels: DataFrame, drop_undersize: bool = False) -> DataFrame:
    """X02 step 1: each labelled document's stratum.

    Classes are visited rarest first (ties by label); a document belongs to its
    rarest label. A stratum of one document moves into the next non-empty
    stratum -- in a run of consecutive size-1 strata the 1st, 3rd, ... move and
    the 2nd, 4th, ... absorb them (closed form of the sequential carry, computed
    on the small class table). An undersized last stratum stays (all dev).
    ``drop_undersize`` drops strata of fewer than 2 documents instead."""
    dl = doc_labels.select("id", "label").distinct()
    sizes = dl.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    ranked = sizes.select("label", F.row_number().over(Window.orderBy("size", "label")).alias("crank"))
    # label-dimension tables are joined without a hint: AQE broadcasts them at
    # run time once their (small) size is known
    strat = (dl.join(ranked, "label")
             .groupBy("id").agg(F.min_by("label", "crank").alias("own")))
    ss = strat.groupBy("own").agg(F.count(F.lit(1)).alias("n")).join(ranked, ranked.label == F.col("own")).drop("label")
    w = Window.orderBy("crank")
    ss = ss.withColumn("_single", (F.col("n") == 1).cast("int"))
    ss = ss.withColumn("_run", F.sum(1 - F.col("_single")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ss = ss.withColumn("_pos", F.row_number().over(Window.partitionBy("_run", "_single").orderBy("crank")))
    ss = ss.withColumn("_next", F.lead("own").over(w))
    moved = (F.col("_single") == 1) & (F.col("_pos") % 2 == 1) & F.col("_next").isNotNull()
    if drop_undersize:
        ss = ss.filter(F.col("n") >= 2).select("own", F.col("own").alias("stratum"))
    else:
        ss = ss.select("own", F.when(moved, F.col("_next")).otherwise(F.col("own")).alias("stratum"))
    return strat.join(ss, "own").select("id", "stratum")


def multilabel_split(doc_labels: DataFrame, seed=23490, test_size: float = 0.2,
                     drop_undersize: bool = False) -> DataFrame:
    """(id, stratum, is_test); documents without labels are in neither side;
    a stratum of one document is all dev."""
    s = multilabel_strata(doc_labels, drop_undersize)
    h = s.withColumn("_h", stable_hash(seed, "stratum", "id"))
    r = grouped_rank(h, ["stratum"], "_h", "id")
    return r.select("id", "stratum",
                    ((F.col("grp_n") >= 2) & (F.col("rn") <= F.ceil(F.col("grp_n") * test_size))).alias("is_test"))


def pair_split(pairs: DataFrame, n_splits: int, seed=0, test_size: float = 0.2) -> DataFrame:
    """Stratified shuffle split of (id, code) pairs, ``n_splits`` times; the
    code is the stratum, each split has its own seed. (split, id, code, is_test)."""
    p = pairs.select("id", "code", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split"))
    h = p.withColumn("_h", stable_hash(seed, "split", "id", "code"))
    r = grouped_rank(h, ["split", "code"], "_h", "id")
    return r.select("split", "id", "code", (F.col("rn") <= F.ceil(F.col("grp_n") * test_size)).alias("is_test"))


def stratified_folds(doc_label: DataFrame, k: int = 5, seed=3) -> DataFrame:
    """fold = (rank within the label in hash order - 1) mod k."""
    h = doc_label.withColumn("_h", stable_hash(seed, "id"))
    r = grouped_rank(h, ["label"], "_h", "id")
    return r.select("id", "label", ((F.col("rn") - 1) % k).cast("int").alias("fold"))


def balanced_negatives(items: DataFrame, exclude: DataFrame, seed=0) -> tuple[DataFrame, DataFrame]:
    """Per label as many negatives as positives, drawn with replacement from
    items whose label is not excluded for it (own label always excluded).

    Items are numbered once in label-contiguous blocks; each positive makes one
    draw u in [0, pool) and u is shifted past the excluded blocks with the small
    (label x excluded-block) table -- then one equi-join on the global index. No
    label x item product is formed. Labels with an empty pool get no negatives
    and a report row. Returns (pairs(label, item_id, polarity), report)."""
    it = items.select("item_id", "label")
    h = it.withColumn("_h", stable_hash(seed, "label", "item_id"))
    r = grouped_rank(h, ["label"], "_h", "item_id")
    blocks = it.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    blocks = blocks.withColumn("off", F.coalesce(F.sum("size").over(
        Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = blocks.agg(F.sum("size").alias("t"))
    idx = r.join(blocks.select("label", "off"), "label").select(
        "item_id", "label", (F.col("off") + F.col("rn") - 1).alias("g"))
    ex = (exclude.select("label", F.col("excluded"))
          .unionByName(blocks.select("label", F.col("label").alias("excluded"))).distinct())
    eb = ex.join(blocks.select(F.col("label").alias("excluded"), "size", "off"), "excluded")
    eb = eb.withColumn("p", F.col("off") - F.coalesce(F.sum("size").over(
        Window.partitionBy("label").orderBy("off").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = eb.groupBy("label").agg(F.sum("size").alias("ex_n"),
                                  F.collect_list(F.struct("p", "size")).alias("ex"))
    tot = bounded_rows(total, 1)[0]["t"]
    per = per.withColumn("pool", F.lit(tot) - F.col("ex_n"))
    report = per.filter(F.col("pool") <= 0).select("label", F.lit("no negative candidates").alias("reason"))
    pos = it.join(per.filter(F.col("pool") > 0), "label")
    u = stable_hash(seed, F.lit("neg"), "label", "item_id") % F.col("pool")
    draws = pos.select("label", F.col("item_id").alias("pos_item"), u.alias("u"), "ex")
    draws = draws.select("label", "pos_item", (F.col("u") + F.aggregate(
        "ex", F.lit(0).cast("bigint"), lambda acc, e: acc + F.when(e["p"] <= F.col("u"), e["size"]).otherwise(0))
    ).alias("g"))
    neg = draws.join(idx.select(F.col("item_id"), "g"), "g").select("label", "item_id", F.lit(0).alias("polarity"))
    posr = it.select("label", "item_id", F.lit(1).alias("polarity"))
    return posr.unionByName(neg), report


def random_labels(ids: DataFrame, labels: list, reps: int, seed=0, cols: dict[str, Column] | None = None) -> DataFrame:
    """Fair-coin label matrix per replicate: (rep, id, label, flag). ``cols`` are more columns of ``ids`` and
    ``label``; they are computed per (id, label), before replicates are expanded."""
    cols = cols or {}
    x = ids.withColumn("label", F.explode(F.array(*[F.lit(l) for l in labels]))).withColumns(cols)
    # by both columns: a deal by id alone is dropped after a grouping by id, and that one is merged to few partitions
    x = dealt(x.select("id", "label", *cols), "id", "label")
    # the text of (id, label) is made once, not once per replicate
    x = x.select("id", "label", *cols, key_text("id", "label").alias("_rest"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    return x.select("rep", "id", "label", *cols, stable_bit(F.concat(F.lit(f"{seed}|"), F.col("rep").cast("string")), "_rest").alias("flag"))


def mask_tokens(tokens: DataFrame, vocab: DataFrame, seed=0, mask_id: int = 1, unk_id: int = 0) -> DataFrame:
    """Masked-token corpus rows from (id, pos, token, is_target).

    Token ids come from a bounded vocabulary (term, token_id in 2..V+1; 0 = unk,
    1 = mask). A target token is always masked; otherwise with r uniform:
    r < .12 mask, < .135 keep, < .15 random id in 1..V-1, else not a target (-100)."""
    v = vocab.select(F.col("term").alias("token"), "token_id")
    t = tokens.join(v, "token", "left").withColumn("tid", F.coalesce("token_id", F.lit(unk_id)))
    vsize = bounded_rows(vocab.agg(F.count(F.lit(1)).alias("n")), 1)[0]["n"] + 2
    r = unit_uniform(seed, "id", "pos")
    rnd = (stable_hash(seed, F.lit("rand"), "id", "pos") % (vsize - 1) + 1)
    inp = (F.when(F.col("is_target") | (r < 0.12), F.lit(mask_id))
           .when(r < 0.135, F.col("tid")).when(r < 0.15, rnd).otherwise(F.col("tid")))
    tgt = F.when(F.col("is_target") | (r < 0.15), F.col("tid")).otherwise(F.lit(-100))
    return t.select("id", "pos", inp.cast("bigint").alias("input_id"), tgt.cast("bigint").alias("target"))


def train_dev(ids: DataFrame, dev: DataFrame | None = None) -> DataFrame:
    """All rows are used for both training and development unless a dev
    set (e.g. an X02 split) is given."""
    if dev is None:
        return ids.select("id", F.lit(True).alias("in_train"), F.lit(True).alias("in_dev"))
    dv = dev.select("id").distinct().withColumn("in_dev", F.lit(True))
    return (ids.select("id").join(dv, "id", "left")
            .select("id", (~F.coalesce("in_dev", F.lit(False))).alias("in_train"),
                    F.coalesce("in_dev", F.lit(False)).alias("in_dev")))


def prediction_rows(chunked: DataFrame, prompt: str | None) -> DataFrame:
    """X11: one row per chunk with the prompt holding the mask slot (or no
    prompt): (id, chunk_id, text, prompt)."""
    p = F.lit(prompt.replace("{}", "[MASK]")) if prompt else F.lit(None).cast("string")
    return chunked.select("id", F.posexplode("chunks").alias("chunk_id", "text")).withColumn("prompt", p)
