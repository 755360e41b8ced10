"""Removal of repeated byte strings of at least ``MIN_BYTES`` bytes.

A byte is removed if a string of ``MIN_BYTES`` bytes that covers it also starts earlier, in a
document with a smaller id or earlier in the same one. Strings never cross documents.

Distribution. Each string (a *window* of MIN_BYTES bytes) belongs to its smallest hashed
``GRAM``-byte gram, its anchor; equal windows have equal anchors. Neighbouring windows with one
anchor form a segment, about 1 for every 35 bytes. Only (anchor, content hash, document key, start,
length) is shuffled; segments that are copies of an earlier one are removed whole (already inside
a task where both are there), and anchors that occur once drop out. The different contents
left, a small part of the text, are fetched and dealt by anchor to blocks of a bounded size.
Anchors whose contents exceed a block are split again by longer grams, up to the whole window, where
all windows of an anchor are equal and the earliest stays.

Per block, the suffix array is built to the needed depth (prefix doubling), from it the
Burrows-Wheeler transform, and common prefixes are derived breadth-first: all intervals of
strings of length 0, 1, 2, ... are extended backwards by one character each, and a suffix
boundary that an interval of length l + 1 reaches first has a common prefix of l. The
expansion stops at ``MIN_BYTES``: boundaries not reached until then join equal windows. In
each class of equal windows the earliest stays, the others are removed.

Documents are keyed by (id, 64-bit hash of the text), in this order, null ids last.

Defined cases: null text is empty text; texts under MIN_BYTES bytes lose nothing; rows of one id (or
none) with different texts are documents of their own, ordered by the hash; rows of one id and text
are one document, so repeated rows lose the same bytes; an empty table gives an empty result; other columns are ignored."""
from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, own_columns, stage, text_bytes

MIN_BYTES = 100
#: Gram lengths of the anchors: first pass, then for anchors with too much content.
GRAMS = (32, 72, 100)
BLOCK_BYTES = 1 << 20
#: An anchor with more bytes of different contents than this is split by the next gram length.
HOT_BYTES = 4 << 20
FLUSH_BYTES = 16 << 20
#: Documents a task remembers to pass over repeated rows.
SEEN = 1 << 18
NO_ID = (1 << 63) - 1

# -- segments -----------------------------------------------------------------------------

_P = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position, by doubling the length of a polynomial hash."""
    h, width, power = b.astype(np.uint64) + np.uint64(1), 1, _P
    out, have = None, 0
    while True:
        if k & 1:
            if out is None:
                out, have = h, width
            else:
                m = len(b) - have - width + 1
                out, have = out[:m] * np.uint64(power) + h[have:have + m], have + width
        k >>= 1
        if not k:
            break
        m = len(h) - width
        h, width, power = h[:m] * np.uint64(power) + h[width:width + m], 2 * width, power * power & _M64
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        a, size = np.minimum(a[:-size], a[size:]), size * 2
    return np.minimum(a[:size - w], a[w - size:]) if size < w else a


def segments(text: bytes, gram: int, least: int = MIN_BYTES):
    """(anchors, starts, ends, again): maximal runs of windows with one smallest gram hash;
    ``again`` marks those in which the anchor occurs twice, so that a window may recur inside."""
    b = np.frombuffer(text, dtype=np.uint8)
    if len(b) < least:
        z = np.zeros(0, np.int64)
        return z, z, z, z > 0
    h, w = gram_hashes(b, gram), least - gram + 1
    m = _sliding_min(h, w)
    cut = np.flatnonzero(m[1:] != m[:-1]) + 1
    starts = np.concatenate(([0], cut))
    anchors = m[starts]
    again = np.zeros(len(starts), dtype=bool)
    # grams that are the smallest of some window, and the pairs of equal ones near each other
    around = np.concatenate((np.zeros(w - 1, np.uint64), m, np.zeros(w - 1, np.uint64)))
    chosen = np.flatnonzero(~_sliding_min(~around, w) == h)
    near = np.flatnonzero((h[chosen[1:]] == h[chosen[:-1]]) & (np.diff(chosen) <= w))
    if len(near):
        p, q = chosen[near], chosen[near + 1]
        k = np.searchsorted(starts, np.maximum(q - w, 0), "right") - 1
        last = np.searchsorted(starts, np.minimum(p, len(m) - 1), "right") - 1
        while len(k):
            again[k[anchors[k] == h[p]]] = True
            go = k < last
            k, last, p = k[go] + 1, last[go], p[go]
    return anchors.view(np.int64), starts, np.concatenate((cut, [len(m)])) + least - 1, again


def _content_hashes(text: bytes, starts, ends) -> np.ndarray:
    from xxhash import xxh3_64_intdigest
    return np.fromiter((xxh3_64_intdigest(text[s:e]) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts)).view(np.int64)


def _first_copies(anchor, content, doc, txt, start):
    """Mask of the rows that are the earliest of their (anchor, content)."""
    order = np.lexsort((start, txt, doc, content, anchor))
    a, c = anchor[order], content[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    mask = np.zeros(len(order), dtype=bool)
    mask[order[first]] = True
    # the earliest row may be there more than once (repeated rows): all of them stay
    if len(order):
        lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        mask[order] |= (doc[order] == doc[lead]) & (txt[order] == txt[lead]) & (start[order] == start[lead])
    return mask


SEGMENT = "anchor long, content long, doc long, txt long, start long, len long, kind long"
#: Kinds of segments: plain, with a window that may recur inside, copy of an earlier one.
PLAIN, AGAIN, COPY = 0, 1, 2


def _segment_rows(docs: DataFrame, gram: int, least: int) -> DataFrame:
    """Segments of all texts. Copies of a segment that comes earlier within the same task are
    known to go; instead of their anchor, which may be hot, they get a mixed one."""
    def run(batches):
        import pyarrow as pa
        held, size, seen = [], 0, set()

        def flush():
            anchor, content, doc, txt, start, length, kind = (np.concatenate(c) for c in zip(*held))
            first = _first_copies(anchor, content, doc, txt, start)
            kind = np.where(first, kind, COPY)
            mixed = (((doc ^ txt).view(np.uint64) * np.uint64(_P) ^ start.view(np.uint64)) * np.uint64(_P)).view(np.int64)
            anchor = np.where(first, anchor, mixed)
            for i in range(0, len(anchor), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 50_000]) for x in (anchor, content, doc, txt, start, length, kind)],
                                                 names=["anchor", "content", "doc", "txt", "start", "len", "kind"])
        for b in batches:
            for doc, txt, text in zip(b.column("doc").to_pylist(), b.column("txt").to_pylist(), b.column("b").to_pylist()):
                if len(text) < least or (doc, txt) in seen:
                    continue  # repeated rows are one document
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add((doc, txt))
                anchor, start, end, again = segments(text, gram, least)
                if len(anchor):
                    held.append((anchor, _content_hashes(text, start, end), np.full(len(anchor), doc, np.int64), np.full(len(anchor), txt, np.int64),
                                 start.astype(np.int64), (end - start).astype(np.int64), again.astype(np.int64)))
                    size += len(text)
                    if size >= FLUSH_BYTES:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()
    return docs.mapInArrow(run, SEGMENT)


# -- Burrows-Wheeler transform and interval expansion -----------------------------------------

def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes in the order of their first ``depth`` codes at least, by
    doubling. Where key and position fit one integer, values are sorted, which is much
    faster than sorting positions."""
    n = len(codes)
    bits, place = max(1, int(codes.max()).bit_length()), n.bit_length()
    packed = 3 * place <= 63
    have = max(1, (63 - place if packed else 62) // bits)
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate((codes.astype(np.int64), np.zeros(have, np.int64)))
    for i in range(have):
        key = (key << bits) | padded[i:i + n]
    at = np.arange(n, dtype=np.int64)
    while True:
        if packed:
            s = np.sort((key << place) | at)
            order = s & ((1 << place) - 1)
            s >>= place
        else:
            order = np.argsort(key)
            s = key[order]
        if have >= depth:
            return order
        rank = np.empty(n, dtype=np.int64)
        number = np.cumsum(s[1:] != s[:-1])
        rank[order[0]] = 0
        rank[order[1:]] = number
        if not n or (n > 1 and number[-1] == n - 1):
            return order
        key = rank << place
        key[:n - have] |= rank[have:]  # all texts end in a separator: what runs over the end is of no account
        have *= 2


def joined_boundaries(codes: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place i of the suffix order, whether suffixes i - 1 and i share ``least`` codes
    at least, by breadth-first backward extension. Code 0 separates texts and is never extended;
    places next to suffixes that meet a separator before ``least`` codes say nothing."""
    n = len(codes)
    bwt = codes[order - 1]  # the first suffix is preceded by the last code, a separator
    front = codes[order]
    lf = np.empty(n, dtype=np.int32)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)
    unset = np.ones(n + 1, dtype=bool)
    unset[0] = unset[n] = False
    lo, hi = np.array([0], dtype=np.int32), np.array([n], dtype=np.int32)
    for _ in range(least):
        size = hi - lo
        ends = np.cumsum(size, dtype=np.int64)
        # all places of all intervals, with the interval they are in
        owner = np.repeat(np.arange(len(lo), dtype=np.int32), size)
        place = np.arange(ends[-1], dtype=np.int32) + np.repeat(lo - (ends - size).astype(np.int32), size)
        keep = bwt[place] != 0
        if not keep.all():
            owner, place = owner[keep], place[keep]
        if not len(place):
            break
        to = lf[place]
        if len(to) * 16 > n:
            # many: mark the targets in place order instead of sorting them
            who = np.full(n, -1, dtype=np.int32)
            who[to] = owner
            at = np.flatnonzero(who >= 0).astype(np.int32)
            who = who[at]
        else:
            o = np.argsort(to)
            at, who = to[o], owner[o]
        ch = front[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (who[1:] != who[:-1]) | (ch[1:] != ch[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        lo = at[first]
        hi = at[np.concatenate((first[1:], [len(at)])) - 1] + np.int32(1)
        fresh = unset[hi]
        unset[hi[fresh]] = False
        lo, hi = lo[fresh], hi[fresh]
        if not len(lo):
            break
    return unset[:n]


def repeated_windows(contents: list[bytes], doc: np.ndarray, start: np.ndarray, least: int = MIN_BYTES):
    """(content number, offset) arrays of the windows that also start earlier in order."""
    raw = np.frombuffer(b"".join(contents), dtype=np.uint8)
    used = np.flatnonzero(np.bincount(raw, minlength=256))
    table = np.zeros(256, dtype=np.uint16 if len(used) > 254 else np.uint8)
    table[used] = np.arange(1, len(used) + 1)
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    codes = np.zeros(len(raw) + len(contents), dtype=table.dtype)
    inside = np.ones(len(codes), dtype=bool)
    ends = np.cumsum(sizes + 1) - 1
    inside[ends] = False
    codes[inside] = table[raw]
    order = suffix_order(codes, least)
    joined = joined_boundaries(codes, order, least)
    # only places joined to a neighbour, and windows that end inside their content
    near = joined.copy()
    near[:-1] |= joined[1:]
    near = np.flatnonzero(near)
    group = np.cumsum(~joined)[near]
    pos = order[near]
    w = np.searchsorted(ends, pos)
    o = pos - (ends - sizes)[w]
    valid = o + least <= sizes[w]
    group, w, o = group[valid], w[valid], o[valid]
    d, s = doc[w], start[w] + o
    by = np.lexsort((s, d, group))
    if not len(by):
        return w, o
    group, w, o, d, s = group[by], w[by], o[by], d[by], s[by]
    first = np.ones(len(by), dtype=bool)
    first[1:] = group[1:] != group[:-1]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    later = (d != d[lead]) | (s != s[lead])
    return w[later], o[later]


def _runs(doc: np.ndarray, start: np.ndarray, least: int):
    """Ranges (doc, start, end) that cover the windows at (doc, start)."""
    if not len(doc):
        return doc, start, start
    by = np.lexsort((start, doc))
    d, s = doc[by], start[by]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(d)])) - 1
    return d[at], s[at], s[last] + least


# -- the job ---------------------------------------------------------------------------------

def _judge(rows: DataFrame) -> DataFrame:
    """Copies, and the segments whose anchor has other contents, with ``first`` (the earliest of its
    content) and ``weight``, the bytes of different contents of the anchor. One shuffle, by anchor."""
    alive = F.col("kind") != COPY
    by_content = Window.partitionBy("anchor", "content").orderBy(F.desc("alive"), "doc", "txt", "start")
    by_anchor = Window.partitionBy("anchor")
    at = F.struct("doc", "txt", "start")
    r = rows.withColumn("alive", alive).repartition("anchor").withColumn("least", F.first(at).over(by_content)).withColumn("nth", F.row_number().over(by_content))
    # the earliest segment, met again in a repeated row, is no copy of itself
    r = r.filter(~F.col("alive") | (F.col("nth") == 1) | (at != F.col("least"))).withColumn("first", F.col("alive") & (F.col("nth") == 1))
    # different contents of the anchor: one alone, that cannot recur inside, has met all its copies
    r = r.withColumn("contents", F.count(F.when(F.col("first"), 1)).over(by_anchor)).withColumn(
        "weight", F.sum(F.when(F.col("first"), F.col("len")).otherwise(0)).over(by_anchor))
    return r.filter((F.col("contents") > 1) | (F.col("kind") != PLAIN) | ~F.col("first")).drop("least", "contents", "alive", "nth")


def _whole(parts: DataFrame, least: int) -> DataFrame:
    """Ranges removed among segments whose gram is the whole window: all windows of an anchor are equal,
    so the earliest one stays and everything else goes. No contents are compared."""
    at = F.struct("doc", "txt", "start")
    p = parts.select("doc", "txt", "start", "len", F.substring("b", 1, least).alias("w"))
    stays = p.groupBy("w").agg(F.min(at).alias("stays"))
    start = F.col("start") + F.when(at == F.col("stays"), 1).otherwise(0)
    return p.join(stays, "w").select("doc", "txt", start.alias("start"), (F.col("start") + F.col("len")).alias("end")).filter(F.col("end") - F.col("start") >= least)


def _blocks(contents: DataFrame, total: int, least: int, block_bytes: int) -> DataFrame:
    """Ranges removed among contents (anchor, doc, txt, start, b), dealt by anchor to blocks."""
    def run(pdf):
        import pandas as pd
        doc, txt = pdf["doc"].to_numpy(), pdf["txt"].to_numpy()
        # documents of the block numbered in order
        by = np.lexsort((txt, doc))
        new = np.ones(len(by), dtype=bool)
        new[1:] = (doc[by[1:]] != doc[by[:-1]]) | (txt[by[1:]] != txt[by[:-1]])
        number = np.empty(len(by), dtype=np.int64)
        number[by] = np.cumsum(new) - 1
        lead = by[new]
        w, o = repeated_windows(pdf["b"].tolist(), number, pdf["start"].to_numpy(), least)
        d, s, e = _runs(number[w], pdf["start"].to_numpy()[w] + o, least)
        return pd.DataFrame({"doc": doc[lead[d]], "txt": txt[lead[d]], "start": s, "end": e})
    n = max(1, -(-total // block_bytes))
    return contents.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(n)).cast("int")).groupBy("block").applyInPandas(
        run, "doc long, txt long, start long, end long")


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of the wanted segments (anchor, doc, txt, start, len). Texts travel compressed."""
    def pack(batches):
        import pyarrow as pa
        import zstandard as z
        c = z.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("txt"), pa.array([c.compress(x) for x in b.column("b").to_pylist()], pa.binary())],
                                             names=["doc", "txt", "z"])

    def cut(batches):
        import pyarrow as pa
        import zstandard as z
        dc = z.ZstdDecompressor()
        for b in batches:
            anchor, doc, txt, start, out, size = [], [], [], [], [], 0
            for d, h, x, ranges in zip(b.column("doc").to_pylist(), b.column("txt").to_pylist(), b.column("z").to_pylist(), b.column("ranges").to_pylist()):
                t = dc.decompress(x)
                for r in ranges:
                    anchor.append(r["anchor"])
                    doc.append(d)
                    txt.append(h)
                    start.append(r["start"])
                    out.append(t[r["start"]:r["start"] + r["len"]])
                    size += r["len"]
                    if size > 8 << 20:
                        yield row(anchor, doc, txt, start, out)
                        anchor, doc, txt, start, out, size = [], [], [], [], [], 0
            yield row(anchor, doc, txt, start, out)

    def row(anchor, doc, txt, start, out):
        import pyarrow as pa
        return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(doc, pa.int64()), pa.array(txt, pa.int64()),
                                           pa.array(start, pa.int64()), pa.array(out, pa.binary())], names=["anchor", "doc", "txt", "start", "b"])
    per_doc = wanted.groupBy("doc", "txt").agg(F.collect_list(F.struct("anchor", "start", "len")).alias("ranges"))
    packed = docs.mapInArrow(pack, "doc long, txt long, z binary")
    return packed.dropDuplicates(["doc", "txt"]).join(per_doc, ["doc", "txt"]).mapInArrow(cut, "anchor long, doc long, txt long, start long, b binary")


def _split(contents: DataFrame, gram: int, least: int) -> DataFrame:
    """Contents cut again into segments of a longer gram: SEGMENT columns and their bytes."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for doc, txt, start, text in zip(b.column("doc").to_pylist(), b.column("txt").to_pylist(), b.column("start").to_pylist(), b.column("b").to_pylist()):
                anchor, s, e, again = segments(text, gram, least)
                h = _content_hashes(text, s, e)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor, pa.int64()), pa.array(h, pa.int64()), pa.array(np.full(len(s), doc, np.int64)),
                     pa.array(np.full(len(s), txt, np.int64)), pa.array(s + start, pa.int64()), pa.array(e - s, pa.int64()), pa.array(again.astype(np.int64)), pa.array([text[i:j] for i, j in zip(s.tolist(), e.tolist())], pa.binary())],
                    names=["anchor", "content", "doc", "txt", "start", "len", "kind", "b"])
    return contents.select("doc", "txt", "start", "b").mapInArrow(run, SEGMENT + ", b binary")


def removed_ranges(d: DataFrame, least: int = MIN_BYTES, grams=None, block_bytes: int = BLOCK_BYTES,
                   hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc, txt, start, end): byte ranges of texts (doc, txt, b) to remove; ranges may overlap."""
    grams = tuple(g for g in (grams or GRAMS) if g < least) + (least,)
    judged = stage(_judge(_segment_rows(d, grams[0], least)), "segments")
    copies = judged.filter(~F.col("first")).select("doc", "txt", "start", (F.col("start") + F.col("len")).alias("end"))
    out = copies
    firsts = judged.filter("first")
    total = firsts.agg(F.sum(F.when(F.col("weight") <= hot_bytes, F.col("len"))), F.max("weight")).first()
    contents = _fetch(d, firsts.filter(F.col("weight") <= hot_bytes).select("anchor", "doc", "txt", "start", "len"))
    out = out.unionByName(_blocks(contents, total[0] or 0, least, block_bytes))
    if (total[1] or 0) > hot_bytes:
        hot = _fetch(d, firsts.filter(F.col("weight") > hot_bytes).select("anchor", "doc", "txt", "start", "len"))
        for gram in grams[1:-1]:
            part = stage(_judge(_split(hot, gram, least)), "split")
            out = out.unionByName(part.filter(~F.col("first")).select("doc", "txt", "start", (F.col("start") + F.col("len")).alias("end")))
            cold = part.filter(F.col("first") & (F.col("weight") <= hot_bytes)).select("anchor", "doc", "txt", "start", "b")
            size = cold.agg(F.sum(F.length("b"))).first()[0] or 0
            out = out.unionByName(_blocks(cold, size, least, block_bytes))
            hot = part.filter(F.col("first") & (F.col("weight") > hot_bytes)).select("anchor", "doc", "txt", "start", "b")
            if not hot.head(1):
                break
        else:
            out = out.unionByName(_whole(_split(hot, least, least), least))
    return out


def dedup_substrings(docs: DataFrame, least: int = MIN_BYTES, texts: bool = False, **limits) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the
    remaining bytes as ``kept`` if ``texts``)."""
    d = own_columns(docs, doc_id=("doc_id", "long"), text=("text", "string"))
    d = d.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), text_bytes("text").alias("b")).withColumn("txt", F.xxhash64("b"))
    ranges = removed_ranges(d, least, **limits)
    per_doc = stage(ranges.distinct().groupBy("doc", "txt").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges")

    def pack(batches):
        import pyarrow as pa
        import zstandard as z
        c = z.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("txt"), pa.array([c.compress(x) for x in b.column("b").to_pylist()], pa.binary())],
                                             names=["doc", "txt", "z"])

    def run(batches):
        import pyarrow as pa
        import zstandard as z
        dc = z.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc, x, found in zip(b.column("doc").to_pylist(), b.column("z").to_pylist(), b.column("ranges").to_pylist()):
                t = dc.decompress(x)
                keep, at, spans, gone = [], 0, 0, 0
                for s, e in sorted((r["start"], r["end"]) for r in found or ()):
                    if s > at or not spans:
                        keep.append(t[at:s])
                        spans += 1
                    gone += max(0, e - max(s, at))
                    at = max(at, e)
                keep.append(t[at:])
                kept = b"".join(keep)
                rows.append((None if doc == NO_ID else doc, len(t), gone, spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) or [[]] * 6
            arrays = [pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            k = 6 if texts else 5
            yield pa.RecordBatch.from_arrays(arrays[:k], names=names[:k])
    packed = d.mapInArrow(pack, "doc long, txt long, z binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    return packed.join(per_doc, ["doc", "txt"], "left").mapInArrow(run, schema)


def op8_suffix_dedup(spark, sf_dir):
    return dedup_substrings(load(spark, sf_dir, "documents"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLES = {}
