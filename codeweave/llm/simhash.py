"""SimHash near-duplicates found by multi-index hashing.

``fingerprints``: 64 bits from the majority of the XXH64 values (seed 42) of all word
shingles, computed per document in Arrow batches; long texts go in blocks.

``link``: pairs of *distinct* fingerprints within ``max_bits`` differing bits. Fingerprints
are cut into segments, one table per segment. Writing ``max_bits = m * a + b`` for ``m``
segments, two fingerprints that near must agree within ``a`` bits in one of the first ``b+1``
segments or within ``a - 1`` in one of the others, so each fingerprint enumerates the Hamming
ball of that radius around its segment values, fetches the table rows stored there and
verifies the complete distance.

Hot table entries (a segment value that many different fingerprints share, as near copies of
one text do) would give a square of pairs. They are left out of the tables and handled
exactly: for fingerprints in hot entries the ball is enumerated on both sides, over the
whole fingerprint and with half the radius, and keyed by the full value reached. Two
fingerprints within ``max_bits`` always meet at a common value, and such a value has at
most as many visitors as the ball has points; every visitor is linked to the smallest one
whose verified distance allows it.

Only distinct fingerprints take part, so copies cost nothing here: a group of a million
copies is one fingerprint. Fingerprint zero (no words) is linked like any other.

Defined cases: null text is empty text (fingerprint zero); fewer words than the shingle length
give one shingle, the whole sequence; a null id never is the component's name unless
all ids are null; repeated rows stay rows; an empty table gives an empty result; other
columns are ignored."""
from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grown, keep_rows, load, own_columns, stage, text_bytes, text_key
from .components import components

SEED = 42
BLOCK = 1 << 16
HOT = 16


def simhash(text: bytes, shingle: int = 3) -> int:
    """Fingerprint as an unsigned integer; only A-Z are lower-cased."""
    from xxhash import xxh64_intdigest
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1:]
    total, n = np.zeros(64, dtype=np.int64), len(starts)
    for i in range(0, n, BLOCK):
        h = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[i:i + BLOCK].tolist(), ends[i:i + BLOCK].tolist())],
                     dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * total > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, txt, fp): txt is the text's key, fp the fingerprint's 64 bits as a signed long."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            fps = np.array([simhash(x, shingle) for x in b.column("b").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("txt"), pa.array(fps)], names=["doc_id", "txt", "fp"])
    d = own_columns(docs, doc_id=("doc_id", "long"), text=("text", "string"))
    return d.select("doc_id", text_key("text").alias("txt"), text_bytes("text").alias("b")).mapInArrow(run, "doc_id long, txt long, fp long")


def _segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments of 64 bits."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def link(fps: DataFrame, max_bits: int = 2, segments: int = 2, hot: int = HOT) -> DataFrame:
    """(a, b): pairs of the distinct ``fp`` values that join all values within ``max_bits``
    bits into components; every pair is within ``max_bits`` bits."""
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    a, b = divmod(max_bits, segments)
    out, hot_fps = None, None
    for i, (shift, width) in enumerate(_segments(segments)):
        radius = a if i <= b else a - 1
        if radius < 0:
            continue
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        table = fps.select("fp", value.alias("v"))
        size = table.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        rows = table.join(grown(size.filter(F.col("n") <= hot)), "v").select("v", F.col("fp").alias("b"))
        probes = table.select(F.col("fp").alias("a"), F.explode(F.array(*[F.lit(m).cast("long") for m in _masks(width, radius)])).alias("m"),
                              F.col("v").alias("own")).select("a", F.col("own").bitwiseXOR(F.col("m")).alias("v"))
        pairs = probes.join(grown(rows), "v").filter((F.col("a") != F.col("b")) & near).select("a", "b")
        over = table.join(grown(size.filter(F.col("n") > hot)), "v", "left_semi").select("fp")
        out = pairs if out is None else out.unionByName(pairs)
        hot_fps = over if hot_fps is None else hot_fps.unionByName(over)
    # hot entries: both sides walk half of the distance and meet
    half = (max_bits + 1) // 2
    step = F.explode(F.array(*[F.lit(_signed(m)) for m in _masks(64, half)]))
    met = hot_fps.distinct().select("fp", step.alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("at"))
    # an odd max_bits lets visitors be max_bits + 1 apart: then only verified neighbours are linked
    if max_bits % 2 == 0:
        least = met.groupBy("at").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        more = met.join(grown(least), "at")
    else:
        more = met.join(grown(met.select("at", F.col("fp").alias("b"))), "at")
    more = more.select(F.col("fp").alias("a"), "b").filter((F.col("a") != F.col("b")) & near)
    return out.unionByName(more).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, segments: int = 2, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest
    doc_id reachable over links of at most ``max_bits`` bits), txt and first_txt (keys of the
    document's text and of the one that a component keeps: smallest id, null last, then smallest key)."""
    f = stage(fingerprints(docs, shingle), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("txt"))
    groups = stage(f.groupBy("fp").agg(F.min(first).alias("first")), "fp-groups")
    pairs = stage(link(groups.select("fp"), max_bits, segments, hot), "links")
    comp = components(pairs)
    named = groups.join(grown(comp), groups.fp == comp.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("first"))
    per_fp = named.select("fp", "component").join(grown(least), "component").select(
        "fp", F.col("first.doc_id").alias("component_id"), F.col("first.txt").alias("first_txt"))
    return f.join(grown(per_fp), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                       "component_id", "txt", "first_txt")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """Whole rows of one document of each component, the one with the smallest id."""
    d = near_duplicates(docs, shingle, max_bits)
    return keep_rows(docs, d.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("txt") == F.col("first_txt"))))


def op3_simhash(spark, sf_dir):
    return near_duplicates(load(spark, sf_dir, "documents"), shingle=3, max_bits=2).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op3_simhash": op3_simhash}
ORACLES = {}
