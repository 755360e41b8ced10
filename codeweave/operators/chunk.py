"""Chunking (C01-C04): greedy non-overlapping packing of ordered units.

Where a document's units live in one row (array), packing is an in-row fold
(``aggregate``) with state (chunk_no, running_tokens, assignments) and the chunk
texts are assembled in-row too: no shuffle. ``pack_rows`` packs units that come as rows, also
of documents longer than a row or a task should hold.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import let
from ..functions.text import word_count
from .scan import running, written


def chunk_assignments(units, max_tokens: int) -> Column:
    """Chunk number of every unit (before dropping an empty first chunk)."""
    init = F.struct(F.lit(0).alias("c"), F.lit(0).alias("prev"), F.array().cast("array<int>").alias("ids"))

    def step(acc, t):
        fits = acc["prev"] + t < max_tokens
        c = F.when(fits, acc["c"]).otherwise(acc["c"] + 1)
        prev = F.when(fits, acc["prev"] + t).otherwise(t)
        return F.struct(c.alias("c"), prev.alias("prev"), F.concat(acc["ids"], F.array(c)).alias("ids"))

    return F.aggregate(F.transform(units, lambda s: word_count(s)), init, step)["ids"]


def packed_chunks(units, max_tokens: int) -> Column:
    """Array<struct<chunk_id, text, n_units>> for one row's ordered units."""
    def build(z):
        return let(F.array_distinct(F.transform(z, lambda e: e["c"])), lambda cs: F.transform(cs, lambda c: let(
            F.filter(z, lambda e: e["c"] == c), lambda part: F.struct(
                (c - F.get(cs, 0)).alias("chunk_id"),
                F.concat(F.when(c == 0, F.lit(" ")).otherwise(F.lit("")),
                         F.concat_ws(" ", F.transform(part, lambda e: e["s"]))).alias("text"),
                F.size(part).alias("n_units")))))

    return let(F.arrays_zip(chunk_assignments(units, max_tokens).alias("c"), units.alias("s")), build)


def pack_units(df: DataFrame, id_cols: list, units_col: str, max_tokens: int) -> DataFrame:
    """Rows (ids..., chunk_id, text, n_units).

    A unit joins the current chunk while tokens(chunk)+tokens(unit) < max (strict);
    otherwise it starts a new chunk (an over-long unit stands alone). The first
    chunk keeps a leading space; an empty first chunk is dropped."""
    out = df.select(*id_cols, F.inline_outer(packed_chunks(F.col(units_col), max_tokens)))
    return out.filter(F.col("chunk_id").isNotNull())


def chunk_count(chunks: DataFrame, id_cols: list) -> DataFrame:
    """C02 helper: number of chunks per document, carried on each chunk row.
    Chunks of one document come from one row, so the window is document-sized."""
    return chunks.withColumn("n_chunks", F.count(F.lit(1)).over(Window.partitionBy(*id_cols)))


def keep_docs_with_chunks(chunks: DataFrame, id_col: str, more_than: int = 2) -> DataFrame:
    """Keep documents with more than ``more_than`` chunks."""
    n = F.count(F.lit(1)).over(Window.partitionBy(id_col))
    return chunks.withColumn("_n", n).filter(F.col("_n") > more_than).drop("_n")


#: Units of a document that are packed in one row.
SHORT = 5_000


def pack_rows(units: DataFrame, max_tokens: int, blocks: int | None = None, short: int = SHORT) -> DataFrame:
    """C01 over rows (id, pos, s): (id, chunk_id, text, n_units), as :func:`pack_units` packs the same units in one row.

    Units are counted first. Documents of at most ``short`` units are gathered and packed in the row, with one
    shuffle of their texts; longer ones (and units without id, position or text) go through :func:`_pack_long`."""
    sizes = units.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("pos").alias("p"), F.count("s").alias("t"))
    rest = written(sizes.filter(f"id is null or n > {short} or p < n or t < n").select("id"), "long")
    if not rest.head(1):
        return _pack_short(units, max_tokens)
    of = F.broadcast(rest) if rest.count() <= NARROW else rest
    same = units["id"].eqNullSafe(of["id"])
    few, many = units.join(of, same, "left_anti"), units.join(of, same, "left_semi")
    return _pack_short(few, max_tokens).unionByName(_pack_long(many, max_tokens, blocks))


#: Most documents whose ids are sent to all tasks.
NARROW = 100_000


def _pack_short(units: DataFrame, max_tokens: int) -> DataFrame:
    doc = units.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("u"))
    return pack_units(doc.select("id", F.transform("u", lambda e: e["s"]).alias("units")), ["id"], "units", max_tokens)


def _pack_long(units: DataFrame, max_tokens: int, blocks: int | None = None) -> DataFrame:
    """:func:`pack_rows` for documents of any length.

    A chunk that starts at unit i ends before the first later unit j with tokens(i..j) >= max, so each unit
    knows the start of the next chunk if one started at it: with running sums S that is the first j
    with S_j >= S_(i-1) + max, found for all units by one ordered scan over sums and thresholds. The
    chunks that really start are those reached from the first unit; they are found by pointer
    doubling, all documents at once, in as many rounds as the logarithm of the most chunks. No task
    holds more of a document than a block of the scans, and no fold runs along it."""
    u = units.select("id", "pos", "s", word_count(F.col("s")).cast("long").alias("t"))
    u = written(running(u, ["id"], ["pos"], {"n": F.lit(1).cast("long"), "sum": F.col("t")}, blocks=blocks), "units")
    null = F.lit(None).cast("long")
    ends = u.select("id", (-F.col("sum")).alias("v"), F.lit(0).alias("kind"), (-F.col("n")).alias("m"), F.col("n").alias("unit"))
    asks = u.select("id", (F.col("t") - F.col("sum") - max_tokens).alias("v"), F.lit(1).alias("kind"), (-F.col("n")).alias("m"), null.alias("unit"))
    # from large sums to small: the last unit seen is the first one that reaches the threshold
    seen = running(ends.unionByName(asks), ["id"], ["v", "kind", "m"], lasts={"nxt": F.col("unit")}, blocks=blocks)
    first = F.greatest("nxt", 1 - F.col("m"))  # an over-long unit stands alone
    last = u.groupBy("id").agg(F.max("n").alias("last"))
    jump = seen.filter("kind = 1 and nxt is not null").select("id", (-F.col("m")).alias("n"), first.alias("nxt"))
    jump = written(jump.join(last, "id").filter(F.col("nxt") <= F.col("last")).select("id", "n", "nxt"), "jumps")
    starts = written(u.filter("n = 1").select("id", "n"), "starts")
    while True:
        new = written(starts.join(jump, ["id", "n"]).select("id", F.col("nxt").alias("n")), "starts")
        if not new.head(1):
            break
        starts = starts.unionByName(new)
        far = jump.select("id", F.col("n").alias("nxt"), F.col("nxt").alias("far"))
        jump = written(jump.join(far, ["id", "nxt"]).select("id", "n", F.col("far").alias("nxt")), "jumps")
    marked = u.join(starts.withColumn("start", F.lit(1).cast("long")), ["id", "n"], "left")
    c = running(marked, ["id"], ["n"], {"chunk": F.col("start")}, blocks=blocks)
    out = c.groupBy("id", "chunk").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("p"), F.min_by("t", "n").alias("t"), F.count(F.lit(1)).cast("int").alias("n_units"))
    space = F.when((F.col("chunk") == 1) & (F.col("t") < max_tokens), F.lit(" ")).otherwise(F.lit(""))
    return out.select("id", (F.col("chunk") - 1).cast("int").alias("chunk_id"), F.concat(space, F.concat_ws(" ", F.transform("p", lambda e: e["s"]))).alias("text"), "n_units")
