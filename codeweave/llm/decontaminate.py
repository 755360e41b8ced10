"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and underscores, lower-cased. Test items are taken in blocks
of at most ``BLOCK_WORDS`` words (the stated bound of what tasks receive); for a block

1. all documents are scanned and, for each n-gram of the block's items, the documents that hold it
   are counted (one number per n-gram and task, summed in Spark);
2. every n-gram of an item that any document holds becomes a seed, so every stretch of ``SEED``
   unchanged words holds one, however often the whole item is repeated in the corpus. Rare
   seeds start alignments at once; those of more than ``FREQUENT`` documents only in passages that
   hold enough of the item's words to reach the score, which loses nothing;
3. all documents are scanned again: seeds lead to (item, passage) candidates, each passage the
   stretch around a seed where the item could lie, merged where they overlap, and word-level
   Smith-Waterman (match +1, mismatch and gap -1) scores the item against the passage.

A document holds an item if the score is at least ``MIN_SCORE`` of the item's words (an edited
word costs 2, an inserted one 1) and at least ``MIN_WORDS`` (or the whole item, if shorter).
No text is shuffled; work per document grows with its length and hits only.

Defined cases: null or empty texts hold nothing; items with fewer than ``SEED`` words have no
seed and match nothing; equal items all match; repeated rows give repeated rows; null ids are
carried as null; empty tables give an empty result; other columns are ignored."""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_batches, load, own_columns, share

SEED = 4
#: Seeds in more documents than this are tested by the passage's words before an alignment.
FREQUENT = 100
MIN_SCORE = 0.5
MIN_WORDS = 8
BLOCK_WORDS = 1 << 20

_WORD = re.compile(r"\w+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit codes of the n-grams of word numbers."""
    code = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    for i in range(n):
        code = (code ^ ids[i:i + len(code)].astype(np.uint64)) * _MUL
        code ^= code >> np.uint64(29)
    return code


class Block:
    """Items of one block: word numbers, and the sorted distinct n-gram codes."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        texts = [words(t or "") for _, t in items]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for t in texts for w in t}))}
        self.items = [np.array([self.vocabulary[w] for w in t], dtype=np.int64) for t in texts]
        grams = [_grams(x, SEED) for x in self.items]
        self.codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams]))
        self.places: dict = {}
        self.rare = np.zeros(len(self.codes), dtype=bool)
        self.grams = grams

    def choose(self, df: np.ndarray) -> None:
        """Seeds by document frequency; ``places``: seed number -> [(item, position)]."""
        keep: dict = {}
        for k, g in enumerate(self.grams):
            for j, c in enumerate(np.searchsorted(self.codes, g).tolist()):
                if df[c]:
                    keep.setdefault(c, []).append((k, j))
        self.places = keep
        self.rare = df <= FREQUENT

    def hits(self, ids: np.ndarray):
        """(positions, code numbers) of the block's n-grams in a document."""
        if len(ids) < SEED:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        run = ids[:len(ids) - SEED + 1] > 0
        for i in range(1, SEED):
            run = run & (ids[i:len(run) + i] > 0)
        at = np.flatnonzero(run)
        if not len(at) or not len(self.codes):
            return at[:0], at[:0]
        code = np.zeros(len(at), dtype=np.uint64)
        for i in range(SEED):
            code = (code ^ ids[at + i].astype(np.uint64)) * _MUL
            code ^= code >> np.uint64(29)
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        ok = self.codes[k] == code
        return at[ok], k[ok]

    def numbers(self, text: str) -> np.ndarray:
        w = words(text)
        get = self.vocabulary.get
        return np.fromiter((get(x, 0) for x in w), np.int64, len(w))


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(best local score, end in the passage); match +1, mismatch and gap -1. Word 0 matches nothing.
    Row by row; gaps along a row are a running maximum."""
    n = len(passage)
    ramp = np.arange(n + 1)
    row = np.zeros(n + 1, dtype=np.int64)
    best, end = 0, 0
    for w in item.tolist():
        t = np.empty(n + 1, dtype=np.int64)
        t[0] = 0
        t[1:] = np.maximum(row[:-1] + np.where(passage == w, 1, -1), row[1:] - 1)
        np.maximum(t, 0, out=t)
        row = np.maximum.accumulate(t + ramp) - ramp
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def _matches(block: Block, text: str):
    """(item number, score, start, end) of the items a text holds; offsets in words."""
    ids = block.numbers(text)
    at, k = block.hits(ids)
    rare = block.rare
    passages: dict = {}
    for p, c in zip(at.tolist(), k.tolist()):
        for item, pos in block.places.get(c, ()):
            n = len(block.items[item])
            slack = n // 3 + 4
            lo, hi = max(0, p - pos - slack), min(len(ids), p - pos + n + slack)
            mine = passages.setdefault(item, [])
            if mine and lo <= mine[-1][1]:
                mine[-1][1] = max(hi, mine[-1][1])
                mine[-1][0] = min(lo, mine[-1][0])
                mine[-1][2] |= rare[c]
            else:
                mine.append([lo, hi, rare[c]])
    for item, spans in passages.items():
        x, found = block.items[item], None
        need = max(MIN_SCORE * len(x), min(len(x), MIN_WORDS))
        for lo, hi, direct in spans:
            # a score needs as many matches, each with another word of the item
            if not direct and np.isin(x, ids[lo:hi]).sum() < need:
                continue
            s, end = smith_waterman(x, ids[lo:hi])
            if s >= need and (found is None or s > found[1]):
                found = (item, s, lo, lo + end)
        if found:
            item, s, lo, end = found
            # the start is the end of the same alignment read backwards
            back, length = smith_waterman(x[::-1], ids[lo:end][::-1])
            yield item, s / len(x), end - length if back == s else lo, end


def _blocks(benchmark: DataFrame, block_words: int):
    """Items in blocks by running words; they come to the driver a block at a time."""
    b = own_columns(benchmark, item_id=("item_id", "long"), text=("text", "string")).filter("text is not null")
    held, size = [], 0
    for row in b.toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(words(row["text"]))
        if size >= block_words:
            yield Block(held)
            held, size = [], 0
    if held:
        yield Block(held)


def _seeded(docs: DataFrame, block: Block):
    """The block, its seeds chosen by the document frequency of its n-grams, as a broadcast."""
    sent = share(docs.sparkSession, block)

    def count(batches):
        import pyarrow as pa
        x = sent.value
        df = np.zeros(len(x.codes), dtype=np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                df[np.unique(x.hits(x.numbers(t))[1])] += 1
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(df[k])], names=["k", "df"])
    d = own_columns(docs, text=("text", "string")).filter("text is not null")
    df = np.zeros(len(block.codes), dtype=np.int64)
    for k, n in d.mapInArrow(count, "k long, df long").groupBy("k").agg(F.sum("df")).collect():
        df[k] = n  # at most one row for each n-gram of the block
    block.choose(df)
    return share(docs.sparkSession, block)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): documents holding test items."""
    d = own_columns(docs, doc_id=("doc_id", "long"), text=("text", "string")).filter("text is not null")
    schema = "doc_id long, item_id long, score double, start_word int, end_word int"
    out = docs.sparkSession.createDataFrame([], schema)
    for i, block in enumerate(_blocks(benchmark, block_words)):
        part = _align(d, _seeded(d, block), schema)
        out = part if i == 0 else out.unionByName(part)
    return out


def _align(d: DataFrame, seeded, schema: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        x = seeded.value
        for b in batches:
            rows = [(i, x.ids[m[0]], *m[1:]) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                    for m in _matches(x, t)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()),
                                              pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())],
                                             names=["doc_id", "item_id", "score", "start_word", "end_word"])
    return d.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Whole rows of the documents that hold no test item."""
    for block in _blocks(benchmark, block_words):
        seeded = _seeded(docs, block)
        docs = filter_batches(docs, "text", lambda texts, s=seeded: [next(_matches(s.value, t), None) is None for t in texts])
    return docs


def op6_decontamination(spark, sf_dir):
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES = {}
