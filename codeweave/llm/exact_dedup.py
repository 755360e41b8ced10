"""Exact duplicates against an immutable snapshot and within a new batch.

Texts are equal when their bytes are equal after deleting every blank and 0x09-0x0D.

* ``build_snapshot`` freezes a corpus: one row per digest in *exact buckets*, and a
  static 3-wise binary-fuse filter (8-bit fingerprints, about 9 bits a key) for each
  shard of the digests. Shards hold a bounded number of digests, so a filter is
  built by one task from at most about ``SHARD_KEYS`` keys; snapshots never change.
* ``dedup_against`` screens the distinct digests of a batch with the filters, joins
  only the positives with the exact buckets and compares the bytes with the bytes of
  the snapshot's row. Equal ones merge their group with the bucket; what the filters
  reject is grouped within the batch alone, and buckets not met pass through.

Hot groups: digests are aggregated before they are shuffled (map-side), so a text that
a third of all rows repeat is one row for the filters and the buckets. The result goes
back to rows by a join on the digest, whose hot keys adaptive execution splits.

Defined cases: null text is empty text; all empty texts are one group; of repeated rows
(same id, same text) one row is kept; ties in length go to the smallest id, a null id
loses against any other; empty tables give empty results; other columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, keep_rows, load, own_columns, stage, text_bytes, text_key

SHARD_KEYS = 1 << 20
NO_ID = (1 << 63) - 1

_M64 = (1 << 64) - 1


# -- binary fuse filter ---------------------------------------------------------------

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply) of keys plus seed."""
    h = keys + np.uint64(seed)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, seg_len: int, segments: int):
    """Three slots of each key in three neighbouring segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    base = first.astype(np.int64) * seg_len
    mask = np.uint64(seg_len - 1)
    a = (h & mask).astype(np.int64)
    b = ((h >> np.uint64(18)) & mask).astype(np.int64)
    c = ((h >> np.uint64(36)) & mask).astype(np.int64)
    return base + a, base + seg_len + b, base + 2 * seg_len + c


def _print8(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_fuse(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, fingerprint bytes) of distinct uint64 keys.
    Peeling goes in rounds: all slots with one key left are peeled at once; keys
    are then assigned in reverse order of the rounds."""
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    n = len(keys)
    if n == 0:
        return 0, 0, 0, b""
    seg_len = max(4, min(1 << 18, 1 << int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    for attempt in range(200):
        # a try that cannot be peeled takes another seed, and in time more room
        segments = max(1, int(np.ceil(n * factor * (1 + 0.05 * (attempt // 10)) / seg_len)) - 2)
        size = (segments + 2) * seg_len
        seed = (0x9E3779B97F4A7C15 * (attempt + 1)) & _M64
        h = _mix(keys, seed)
        slots = np.stack(_slots(h, seg_len, segments))
        count = np.bincount(slots.ravel(), minlength=size)
        which = np.zeros(size, dtype=np.int64)
        idx = np.arange(n, dtype=np.int64)
        for s in slots:
            np.bitwise_xor.at(which, s, idx)
        rounds, left = [], n
        single = np.flatnonzero(count == 1)
        while len(single):
            k, first = np.unique(which[single], return_index=True)
            own = single[first]
            rounds.append((k, own))
            left -= len(k)
            touched = slots[:, k]
            for s in touched:
                np.subtract.at(count, s, 1)
                np.bitwise_xor.at(which, s, k)
            near = np.unique(touched)
            single = near[count[near] == 1]
        if left == 0:
            table = np.zeros(size, dtype=np.uint8)
            want = _print8(h)
            for k, own in reversed(rounds):
                s0, s1, s2 = slots[:, k]
                table[own] = 0
                table[own] = want[k] ^ table[s0] ^ table[s1] ^ table[s2]
            return seed, seg_len, segments, table.tobytes()
    raise ValueError("binary-fuse construction failed")


def probe_fuse(fuse: tuple, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold: no false negatives, about 1 in 256 false positives."""
    seed, seg_len, segments, table = fuse
    keys = np.asarray(keys, dtype=np.uint64)
    if not table:
        return np.zeros(len(keys), dtype=bool)
    t = np.frombuffer(table, dtype=np.uint8)
    h = _mix(keys, seed)
    a, b, c = _slots(h, seg_len, segments)
    return _print8(h) == (t[a] ^ t[b] ^ t[c])


# -- digests --------------------------------------------------------------------------

def digest_rows(df: DataFrame) -> DataFrame:
    """(doc_id, n_cp, txt, sha): code points and key of the text, SHA-256 of the normalised bytes."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            shas = [hashlib.sha256(x.translate(None, SPACE_BYTES)).digest() for x in b.column("b").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_cp"), b.column("txt"), pa.array(shas, pa.binary())],
                                             names=["doc_id", "n_cp", "txt", "sha"])
    raw = df.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_cp"), text_key("text").alias("txt"),
                    text_bytes("text").alias("b"))
    return raw.mapInArrow(run, "doc_id long, n_cp long, txt long, sha binary")


def _norm(col: str):
    return F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"[\x20\x09-\x0D]", "")


def _texts(df: DataFrame, id_name: str, key_name: str, text_name: str) -> DataFrame:
    """Ids (null as NO_ID), text keys and texts under other names."""
    return df.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(id_name), text_key("text").alias(key_name), F.col("text").alias(text_name))


def _key(sha: str = "sha"):
    """First 8 bytes of the digest as a long: the key of filters and buckets."""
    return F.conv(F.substring(F.hex(sha), 1, 15), 16, 10).cast("long")


def _best(is_new: bool):
    """The row that stays: most code points, then smallest id (null last), smallest text key, then the snapshot's."""
    return F.min(F.struct((-F.col("n_cp")).alias("neg_cp"), F.col("doc_id").isNull().alias("no_id"),
                          F.col("doc_id").alias("doc_id"), F.col("txt").alias("txt"), F.lit(is_new).alias("is_new"))).alias("best")


class Snapshot:
    """Exact buckets (sha, key, best, size) and filters (shard, seed, ..., table)."""

    def __init__(self, buckets: DataFrame, filters: DataFrame, shards: int):
        self.buckets, self.filters, self.shards = buckets, filters, shards


def build_snapshot(digests: DataFrame, shard_keys: int = SHARD_KEYS, batch_keys: int = 0) -> Snapshot:
    """Freeze digests (doc_id, n_cp, sha) as an immutable snapshot in the shared folder. Shards
    hold about ``shard_keys`` digests of the snapshot, and of a batch of ``batch_keys``, at most."""
    buckets = stage(digests.groupBy("sha").agg(_best(False), F.count(F.lit(1)).alias("size"))
                    .withColumn("key", _key()), "exact-buckets")
    shards = max(1, -(-max(buckets.count(), batch_keys) // shard_keys))

    def build(pdf):
        import pandas as pd
        seed, seg, segs, table = build_fuse(pdf["key"].to_numpy().astype(np.uint64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "seed": [str(seed)], "seg_len": [seg],
                             "segments": [segs], "table": [table]})
    filters = (buckets.select("key", F.pmod("key", F.lit(shards)).cast("int").alias("shard"))
               .groupBy("shard").applyInPandas(build, "shard int, seed string, seg_len long, segments long, table binary"))
    return Snapshot(buckets, stage(filters, "fuse-filters"), shards)


def screen(keys: DataFrame, snap: Snapshot) -> DataFrame:
    """Of distinct batch keys, those a filter of the snapshot lets through."""
    def probe(left, right):
        import pandas as pd
        if not len(left) or not len(right):
            return pd.DataFrame({"key": pd.Series([], dtype="int64")})
        f = right.iloc[0]
        hit = probe_fuse((int(f["seed"]), int(f["seg_len"]), int(f["segments"]), f["table"]),
                         left["key"].to_numpy().astype(np.uint64))
        return left.loc[hit, ["key"]]
    return (keys.withColumn("shard", F.pmod("key", F.lit(snap.shards)).cast("int")).groupBy("shard")
            .cogroup(snap.filters.groupBy("shard")).applyInPandas(probe, "key long"))


def dedup_against(old: DataFrame, new: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per row of both tables (doc_id, text): doc_id, keep_id, group_size, kept,
    text_sha256, txt (the text's key). ``old`` becomes the snapshot, ``new`` is the batch screened by it."""
    rows = stage(digest_rows(old).withColumn("is_new", F.lit(False)).unionByName(digest_rows(new).withColumn("is_new", F.lit(True))), "digests")
    keys = stage(rows.filter("is_new").select("sha").distinct().withColumn("key", _key()), "batch")
    snap = build_snapshot(rows.filter(~F.col("is_new")), shard_keys, keys.count())
    positive = stage(screen(keys.select("key").distinct(), snap), "positives")
    # exact buckets: the digests of the batch that the snapshot really holds
    held = stage(snap.buckets.join(positive, "key", "left_semi").join(keys.select("sha"), "sha", "left_semi")
                 .select("sha", F.col("best").alias("old_best"), F.col("size").alias("old_size")), "held")
    # repeated rows of a document fold into one with their number
    folded = rows.groupBy("doc_id", "txt", "sha", "is_new").agg(F.max("n_cp").alias("n_cp"), F.count(F.lit(1)).alias("n"))
    folded = stage(folded.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))), "folded")
    # a join alone, without an aggregate on its key, so that a digest with many documents is split
    rivals = held.select("sha", F.coalesce("old_best.doc_id", F.lit(NO_ID)).alias("old_id"), F.col("old_best.txt").alias("old_txt"))
    hits = stage(folded.filter("is_new").select("id", "txt", "sha").join(rivals, "sha"), "hits")
    # bytes of both sides, only for rows that hit: same digest, other bytes would be another text
    theirs = _texts(new, "id", "txt", "b").join(hits.select("id", "txt"), ["id", "txt"], "left_semi").select("id", "txt", _norm("b").alias("new_norm"))
    ours = _texts(old, "old_id", "old_txt", "b").dropDuplicates(["old_id", "old_txt"]).join(
        rivals.select("old_id", "old_txt"), ["old_id", "old_txt"], "left_semi").select("old_id", "old_txt", _norm("b").alias("old_norm"))
    differ = (hits.join(theirs, ["id", "txt"]).join(ours, ["old_id", "old_txt"]).filter(F.col("new_norm") != F.col("old_norm"))
              .select("id", "txt", "sha", F.lit(True).alias("is_new"), F.lit(1).alias("other")).distinct())
    folded = folded.join(differ, ["id", "txt", "sha", "is_new"], "left").withColumn("grp", F.coalesce("other", F.lit(0))).drop("other")
    # groups of the batch alone; the screened ones among them merge with their exact bucket
    mine = stage(folded.filter("is_new").groupBy("sha", "grp").agg(_best(True), F.sum("n").alias("size")).withColumn("key", _key()), "batch-groups")
    screened = mine.filter("grp = 0").join(positive, "key", "left_semi").join(held, "sha", "left")
    merged = stage(screened.select("sha", "grp", F.least("best", "old_best").alias("best"),
                                   (F.col("size") + F.coalesce("old_size", F.lit(0))).alias("size")), "merged")
    rejected = mine.filter("grp = 1").unionByName(mine.filter("grp = 0").join(positive, "key", "left_anti")).select("sha", "grp", "best", "size")
    # buckets the batch does not meet pass through
    theirs = merged.select("sha", F.col("best").alias("new_best"), F.col("size").alias("new_size"))
    passed = snap.buckets.join(theirs, "sha", "left").select(
        "sha", F.lit(0).alias("grp"), F.coalesce("new_best", "best").alias("best"), F.coalesce("new_size", "size").alias("size"))
    groups = merged.unionByName(rejected).withColumn("is_new", F.lit(True)).unionByName(passed.withColumn("is_new", F.lit(False)))
    out = folded.join(groups, ["sha", "grp", "is_new"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), F.col("sha"), "txt", "n",
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("txt") == F.col("best.txt")) & (F.col("is_new") == F.col("best.is_new"))).alias("stays"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"), "txt")


def split_snapshot(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Half of the documents (by a hash of the id) play the frozen snapshot, the others the batch."""
    d = own_columns(docs, doc_id=("doc_id", "long"), text=("text", "string"))
    old = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.lit(False))
    return d.filter(old), d.filter(~old)


def keep_unique(docs: DataFrame) -> DataFrame:
    """Whole rows of the documents that stay."""
    return keep_rows(docs, dedup_against(*split_snapshot(docs)).filter("kept"))


def op10_exact_dedup(spark, sf_dir):
    return dedup_against(*split_snapshot(load(spark, sf_dir, "documents"))).drop("txt")


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLES = {"op10_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn,
        count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r"""}
