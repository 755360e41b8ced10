"""Toxicity with noisy-channel deobfuscation.

1. A character trigram model is counted over *all* documents (numpy counts per partition,
   summed in Spark). The table is bounded by the alphabet: at most 64**3 numbers.
2. Disguised tokens become character lattices: leetspeak signs may stand for letters, runs of
   three or more equal letters for one or two, separators between single letters for nothing
   or for a word border. A Viterbi search finds the most likely reading under the model.
   A token without such signs has one reading only, itself.
3. A logistic model over the presence of restored words and of their first letters (``STEMS``, for
   inflected forms) is learned from the labelled documents that are not held out, each
   different text once. Candidates are the ``MAX_WORDS`` features with the largest log-likelihood
   ratio of those with an odds ratio over ``MIN_ODDS``; the documents fold into weighted (label, candidates) patterns, of which
   at most ``MAX_PATTERNS`` reach the solver.
4. Every whole text is restored and scored.

The labels only meet texts in training; score inputs are the text alone.

Defined cases: null text is empty text; an empty text gets the model's base rate; a null id is
never held out and never trained on; a document labelled twice counts as toxic if any label says so;
null labels are no labels; with no labels, or of one class only, every score is that
class's share (0 without labels); repeated rows stay rows; an empty table gives an empty result."""
from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_batches, load, own_columns, share, stage, text_bytes

THRESHOLD = 0.7
MAX_WORDS = 2000
MIN_TOXIC = 3
#: A candidate raises the odds of a toxic text by more than this factor.
MIN_ODDS = 2
PRIOR_VARIANCE = 100.0
#: Bound of what the model is fitted on: different (label, features) patterns of labelled documents.
MAX_PATTERNS = 100_000
CACHE = 150_000
#: Lengths of word beginnings that are features besides whole words.
STEMS = (4, 5, 6, 7)

#: Letters a sign may stand for (fixed values).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
P_LEET, P_SAME, P_DROP, P_NO_SIGN = math.log(0.3), 0.0, math.log(0.5), math.log(0.02)

# -- character model --------------------------------------------------------------------

SIZE = 64
BORDER, OTHER = 0, 63


def _alphabet() -> np.ndarray:
    """Class of each code point below 256: a-z and the lower-case Latin-1 letters have their own,
    everything else is a border; code points from 256 are looked up as letters of one class."""
    t = np.zeros(256, dtype=np.int64)
    for i, c in enumerate([*range(ord("a"), ord("z") + 1), *(c for c in range(0xDF, 0x100) if c != 0xF7)]):
        t[c] = i + 1
    return t


ALPHABET = _alphabet()


def classes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(cp < 256, ALPHABET[np.minimum(cp, 255)], OTHER)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(code, n) over all texts; code = (c1 * 64 + c2) * 64 + c3."""
    def run(batches):
        import pyarrow as pa
        total = np.zeros(SIZE ** 3, dtype=np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                c = classes("  " + t.lower() + " ")
                code, n = np.unique((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], return_counts=True)
                total[code] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])
    d = own_columns(docs, text=("text", "string"))
    return d.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "code long, n long") \
        .groupBy("code").agg(F.sum("n").alias("n"))


def trigram_model(counts: list) -> np.ndarray:
    """log P(c3 | c1 c2), trigrams interpolated with bigrams and single characters."""
    n = np.zeros((SIZE, SIZE, SIZE))
    for code, k in counts:
        n[code // SIZE ** 2, code // SIZE % SIZE, code % SIZE] = k
    one = n.sum((0, 1)) + 1.0
    one /= one.sum()
    two = n.sum(0)
    two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
    three = (n + 5 * two[None]) / (n.sum(2, keepdims=True) + 5)
    return np.log(three).astype(np.float32)


# -- lattice and Viterbi ----------------------------------------------------------------

_LETTER = re.compile(r"[^\W\d_]")
_ODD = re.compile(r"[0-9@$!|+(€£*]|([^\W\d_])\1\1")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$") + "…„“”‘’«»–—¿¡·"
_RUN = re.compile(r"([@$])\1+$|^([@$])\2+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|])(?:[ ._*\-]{1,2}(?:[^\W_]|[@$!|])){3,}(?![^\W_])")


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Positions, each with the readings (characters or nothing, log channel probability)."""
    out, i = [], 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        run = j - i
        if c in " ._*-":
            # a separator: dropped, or the border of two words; a star may hide a letter
            out.append([("", P_DROP), (" ", P_DROP)] + ([(x, math.log(0.5 / 26)) for x in "abcdefghijklmnopqrstuvwxyz"]
                                                         if c == "*" and run == 1 else []))
        elif c in LEET:
            for _ in range(run if run < 3 else 1):
                out.append([(x, P_LEET) for x in LEET[c]] + ([] if c.isdigit() else [("", P_NO_SIGN)]))
        elif _LETTER.match(c):
            out.append([(c, P_SAME)])
            if run == 2:
                out.append([(c, P_SAME)])
            elif run > 2:
                out.append([("", P_DROP), (c, P_DROP)])
        else:
            out.append([("", P_SAME)])
        i = j
    return out


def _class(c: str) -> int:
    o = ord(c)
    return int(ALPHABET[o]) if o < 256 else OTHER


def viterbi(token: str, lm: np.ndarray) -> str:
    """The most likely reading of a disguised token."""
    # state: classes of the last two characters; value: (score, link to the text read so far)
    states = {(BORDER, BORDER): (0.0, None)}
    for position in [*lattice(token), [(" ", 0.0)]]:
        new: dict = {}
        for (a, b), (score, text) in states.items():
            for c, p in position:
                if c:
                    k = _class(c)
                    s, key, link = score + p + float(lm[a, b, k]), (b, k), (text, c)
                else:
                    s, key, link = score + p, (a, b), text
                old = new.get(key)
                if old is None or s > old[0]:
                    new[key] = (s, link)
        states = new
    _, link = max(states.values(), key=lambda x: x[0])
    chars = []
    while link is not None:
        link, c = link
        chars.append(c)
    return "".join(reversed(chars)).strip()


def restore_token(token: str, lm: np.ndarray) -> str:
    """A lower-case token without edge punctuation, read through the channel if it is disguised."""
    t = _RUN.sub("", token.strip(_EDGE)).strip(_EDGE)
    if _ODD.search(t) and _LETTER.search(t):
        return viterbi(t, lm)
    return t


def features(restored: str) -> list[str]:
    """Words of a restored text and their beginnings (marked by a dash)."""
    out = []
    for w in restored.split():
        out.append(w)
        out += [w[:k] + "-" for k in STEMS if len(w) > k]
    return out


def feature_column(words: str):
    """The same from an array of distinct words, as a Column."""
    begin = ", ".join(f"IF(length(w) > {k}, concat(left(w, {k}), '-'), w)" for k in STEMS)
    return F.expr(f"array_distinct(flatten(transform({words}, w -> array(w, {begin}))))")


def text_words(text: str, lm: np.ndarray, cache: dict) -> set:
    """Distinct words of the restored text."""
    return text_features(text, lm, cache, None, str.split)


def text_features(text: str, lm: np.ndarray, cache: dict, keep=None, features=features) -> set:
    """Distinct features of the restored text; with ``keep``, only those in it. ``cache``
    maps tokens to their features."""
    low = text.lower()
    found = set()
    for token in set(low.split()):
        f = cache.get(token)
        if f is None:
            if len(cache) > CACHE:
                cache.clear()
            f = features(restore_token(token, lm))
            f = cache[token] = tuple(f if keep is None else (x for x in f if x in keep))
        if f:
            found.update(f)
    for m in _SPACED.finditer(low):
        if _LETTER.search(m[0]):
            found.update(x for x in features(viterbi(m[0], lm)) if keep is None or x in keep)
    return found


def restore(text: str, lm: np.ndarray) -> str:
    """The whole text, lower-cased and restored."""
    low = _SPACED.sub(lambda m: viterbi(m[0], lm) if _LETTER.search(m[0]) else m[0], text.lower())
    return " ".join(filter(None, (restore_token(t, lm) for t in low.split())))


# -- training and scoring ---------------------------------------------------------------

def held_out(col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _word_rows(docs: DataFrame, ids: DataFrame, lm) -> DataFrame:
    """(doc_id, toxic, words): distinct restored words of the documents in ``ids`` (doc_id,
    toxic). Texts are shuffled compressed."""
    def pack(batches):
        import pyarrow as pa
        import zstandard as z
        c = z.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c.compress(x) for x in b.column("b").to_pylist()], pa.binary())],
                                             names=["doc_id", "z"])

    def run(batches):
        import pyarrow as pa
        import zstandard as z
        cache: dict = {}
        d = z.ZstdDecompressor()
        for b in batches:
            words = [sorted(text_words(d.decompress(x).decode("utf-8", "replace"), lm.value, cache)) for x in b.column("z").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(words, pa.list_(pa.string()))],
                                             names=["doc_id", "toxic", "words"])
    packed = docs.select("doc_id", text_bytes("text").alias("b")).mapInArrow(pack, "doc_id long, z binary")
    return packed.join(ids, "doc_id").dropDuplicates(["doc_id", "toxic"]).mapInArrow(run, "doc_id long, toxic int, words array<string>")


def train(docs: DataFrame, labels: DataFrame, lm, max_words: int = MAX_WORDS) -> tuple[dict, float]:
    """(weights by word, bias) from the labelled documents that are not held out."""
    y = own_columns(labels, doc_id=("doc_id", "long"), toxic=("toxic", "int"))
    y = y.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = own_columns(docs, doc_id=("doc_id", "long"), text=("text", "string"))
    # one document per text and label: a copied text is one piece of evidence
    ids = (d.filter(~held_out()).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).join(y, "doc_id")
           .groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic"))
    rows = stage(_word_rows(d.filter(~held_out()), ids, lm), "toxic-words").withColumn("words", feature_column("words"))
    n, t = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if t in (0, n):
        return {}, 40.0 if n and t == n else -40.0
    w = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("toxic").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("k"))
    share = t / n
    # odds of toxic texts among those with the feature, against the odds of all: works at any share
    w = w.filter((F.col("a") >= MIN_TOXIC) & (F.col("a") * (1 - share) > MIN_ODDS * share * (F.col("k") - F.col("a"))))
    p = F.col("a") / F.col("k")

    def term(x, y):
        return F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    llr = term(F.col("a"), F.col("k") * share) + term(F.col("k") - F.col("a"), F.col("k") * (1 - share))
    words = [r[0] for r in w.withColumn("llr", llr).withColumn("p", p).orderBy(F.desc("llr"), "word").limit(max_words).select("word").collect()]
    if not words:
        return {}, math.log(share / (1 - share))
    at = F.array(*[F.lit(x) for x in words])
    patterns = (rows.select("toxic", F.array_sort(F.array_intersect("words", at)).alias("f"))
                .groupBy("toxic", "f").agg(F.count(F.lit(1)).alias("weight")))
    # the patterns that fit: all of them, or MAX_PATTERNS in the order of a hash
    sample = patterns.withColumn("h", F.xxhash64("toxic", "f")).orderBy("h").limit(MAX_PATTERNS)
    number = {x: i for i, x in enumerate(words)}

    def run(batches):
        import pyarrow as pa
        for b in batches:
            f = [[number[x] for x in row] for row in b.column("f").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("weight"), pa.array(f, pa.list_(pa.int32()))], names=["toxic", "weight", "f"])
    got = sample.select("toxic", "weight", "f").mapInArrow(run, "toxic int, weight long, f array<int>").collect()
    w, bias = logistic([r["f"] for r in got], np.array([r["toxic"] for r in got], float), np.array([r["weight"] for r in got], float),
                       len(words), 1 / PRIOR_VARIANCE)
    return dict(zip(words, w.tolist())), bias


def logistic(patterns: list, y: np.ndarray, weight: np.ndarray, n: int, ridge: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model with a Gaussian prior (the bias is free), by Newton
    steps; each is solved by conjugate gradients over the sparse rows."""
    col = np.array([j for f in patterns for j in [*f, n]], dtype=np.int64)  # feature n is the bias
    row = np.repeat(np.arange(len(patterns)), [len(f) + 1 for f in patterns])
    penalty = np.append(np.full(n, ridge), 1e-9)

    def times(v):
        return np.bincount(row, v[col], len(patterns))

    def back(r):
        return np.bincount(col, r[row], n + 1)

    def loss(w):
        z = times(w)
        return float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * penalty @ (w * w))
    w, now = np.zeros(n + 1), None
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(times(w), -50, 50)))
        g = back(weight * (p - y)) + penalty * w
        h = weight * p * (1 - p)
        # conjugate gradients on (X' h X + penalty) d = -g
        d, r = np.zeros(n + 1), -g
        q, rr = r.copy(), float(g @ g)
        first = rr
        for _ in range(200):
            if rr <= 1e-12 * first or rr == 0:
                break
            hq = back(h * times(q)) + penalty * q
            a = rr / float(q @ hq)
            d, r = d + a * q, r - a * hq
            new = float(r @ r)
            q, rr = r + new / rr * q, new
        now = loss(w) if now is None else now
        step = 1.0
        while step > 1e-6 and (then := loss(w + step * d)) > now + 1e-4 * step * float(g @ d):
            step /= 2
        w = w + step * d
        if now - then <= 1e-9 * abs(now):
            break
        now = then
    return w[:n], float(w[n])


class Scorer:
    """Scores of texts; tokens already seen by a worker are looked up."""

    def __init__(self, lm, weights: dict, bias: float):
        self.lm, self.weights, self.bias, self.cache = lm, weights, bias, {}

    def __call__(self, text: str) -> float:
        w = self.weights
        z = self.bias + math.fsum(map(w.get, text_features(text, self.lm, self.cache, w)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def fit(docs: DataFrame, labels: DataFrame):
    """Broadcast scorer: character model of all documents, weights of the labelled ones."""
    spark = docs.sparkSession
    counts = [(r["code"], r["n"]) for r in trigram_counts(docs).collect()]  # at most 64**3 rows
    model = trigram_model(counts)
    return share(spark, Scorer(model, *train(docs, labels, share(spark, model))))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scorer = fit(docs, labels)

    def run(batches):
        import pyarrow as pa
        score = scorer.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(score, b.column("text").to_pylist()), pa.float64())],
                                             names=["doc_id", "score"])
    d = own_columns(docs, doc_id=("doc_id", "long"), text=("text", "string"))
    s = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Whole rows of the documents that score below the threshold."""
    scorer = fit(docs, labels)
    return filter_batches(docs, "text", lambda texts: [scorer.value(t) < threshold for t in texts])


def op9_toxicity(spark, sf_dir):
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES = {}
