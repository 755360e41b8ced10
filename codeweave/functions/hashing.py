"""Deterministic pseudo-randomness as a Column expression.

h(seed, key...) = first 60 bits of md5("seed|key|...") as a non-negative BIGINT.
Same value in Spark and in DuckDB (`CAST('0x' || substr(md5(...),1,15) AS BIGINT)`),
so every seeded choice (splits, folds, draws, bootstrap) is reproducible and checkable.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60
SPAN = 1 << HASH_BITS
#: DuckDB text of the span, for oracles.
SQL_SPAN = f"CAST({SPAN} AS DOUBLE)"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def stable_hash(seed, *keys) -> Column:
    parts = [F.lit(str(seed))] + [_c(k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint")


def key_text(*keys) -> Column:
    """The part of the hashed text that ``keys`` make, each with the bar before it (nulls leave none)."""
    return F.concat(*[F.coalesce(F.concat(F.lit("|"), _c(k).cast("string")), F.lit("")) for k in keys])


def stable_bit(head, rest) -> Column:
    """``stable_hash(...) % 2`` as an int, of the two parts of the hashed text; read off the last of the
    hexadecimal digits, so that no number is parsed."""
    return F.substring(F.md5(F.concat(_c(head), _c(rest))), 15, 1).isin(*"13579bdf").cast("int")


def unit_uniform(seed, *keys) -> Column:
    """Uniform [0,1) from the hash."""
    return stable_hash(seed, *keys) / F.lit(float(SPAN))


def sql_hash(seed, *keys: str) -> str:
    """DuckDB twin of :func:`stable_hash` (for oracles)."""
    parts = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 15)) AS BIGINT)"


_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]


def hashes_of_numbers(head: str, lo: int, hi: int):
    """numpy twin of ``stable_hash`` for the keys lo..hi-1: hashes of head + key, ``head`` being "seed|key...|" of at most
    36 bytes. The steps of MD5 are done for all keys at once, as a task needs millions of them."""
    import numpy as np
    text = head.encode()
    if len(text) + 19 > 55:
        raise ValueError("the hashed text must fit in one MD5 block")
    out, start = [], lo
    while start < hi:
        digits = len(str(start))
        end = min(hi, 10 ** digits)
        n, size = end - start, len(text) + digits
        raw = np.zeros((n, 64), np.uint8)
        raw[:, :len(text)] = np.frombuffer(text, np.uint8)
        rest = np.arange(start, end, dtype=np.int64)
        for at in range(size - 1, len(text) - 1, -1):
            raw[:, at] = rest % 10 + 48
            rest = rest // 10
        raw[:, size] = 0x80
        raw[:, 56:58] = (size * 8 & 255, size * 8 >> 8)
        out.append(_first_bits(np.ascontiguousarray(raw.view("<u4").T), (n,)))
        start = end
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


#: Digests that are made at once.
TEXTS = 1 << 15


def hashes_of_texts(seed, reps: int, rests: list):
    """numpy twin of ``stable_hash(seed, rep, ...)``, for each rep from 0 to reps-1 an array over ``rests`` (bytes, the part
    that :func:`key_text` gives): (rep, start, hashes of the rests from start on)."""
    import hashlib

    import numpy as np
    head = f"{seed}|".encode()
    for start in range(0, len(rests), TEXTS):
        some = rests[start:start + TEXTS]
        by_length: dict = {}
        for i, x in enumerate(some):
            by_length.setdefault(len(x), []).append(i)
        together, lo, blocks = max(1, TEXTS // len(some)), 0, {}
        while lo < reps:  # reps with as many digits, some at once
            digits = len(str(lo))
            numbers = range(lo, min(reps, 10 ** digits, lo + together))
            texts = [str(rep).encode() for rep in numbers]
            number = np.zeros((len(texts), 64), np.uint8)
            number[:, len(head):len(head) + digits] = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, digits)
            number = number.view("<u4")
            out = np.empty((len(texts), len(some)), np.int64)
            for length, at in by_length.items():
                size = len(head) + digits + length
                if size > 55:  # two MD5 blocks
                    out[:, at] = [[int(hashlib.md5(head + x + some[i]).hexdigest()[:HASH_BITS // 4], 16) for i in at] for x in texts]
                    continue
                if (digits, length) not in blocks:
                    raw = np.zeros((len(at), 64), np.uint8)
                    raw[:, :len(head)] = np.frombuffer(head, np.uint8)
                    raw[:, size - length:size] = np.frombuffer(b"".join(some[i] for i in at), np.uint8).reshape(len(at), length)
                    raw[:, size] = 0x80
                    raw[:, 56:58] = (size * 8 & 255, size * 8 >> 8)
                    blocks[digits, length] = np.ascontiguousarray(raw.view("<u4").T)
                words = blocks[digits, length]
                out[:, at] = _first_bits([w | n[:, None] if n.any() else w for w, n in zip(words, number.T)], out[:, at].shape)
            for rep, hashes in zip(numbers, out):
                yield rep, start, hashes
            lo += len(texts)


def _first_bits(words, shape):
    """The first 60 bits of the MD5 digests of blocks of 16 words (one array a word, together of ``shape``)."""
    import math

    import numpy as np
    first = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(shape, x, np.uint32) for x in first)
    for i, turn in enumerate(_TURNS):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[g]
        f += np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32))
        a, d, c, b = d, c, b, b + (f << np.uint32(turn) | f >> np.uint32(32 - turn))
    high, low = ((x + y).byteswap().astype(np.uint64) for x, y in ((a, first[0]), (b, first[1])))
    return ((high << np.uint64(32) | low) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
