"""Exact, SimHash and substring duplicates against brute force."""
import hashlib
import random

import numpy as np
import pytest

from codeweave.llm import exact_dedup, simhash, suffix_dedup
from codeweave.llm.components import components

from .helpers import docs


# -- exact ------------------------------------------------------------------------------------

def brute_exact(rows):
    groups = {}
    for d, t in rows:
        n = (t or "").encode().translate(None, b" \t\n\x0b\x0c\r")
        groups.setdefault(n, []).append((-len(t or ""), d is None, d))
    out = []
    for n, g in groups.items():
        best = min(g, key=lambda x: (x[0], x[1], x[2] or 0))
        for i, x in enumerate(sorted(g, key=lambda x: (x[0], x[1], x[2] or 0))):
            out.append((x[2], best[2], len(g), i == 0, hashlib.sha256(n).hexdigest()))
    return sorted(out, key=repr)


EXACT = [(1, "a b"), (2, "ab"), (3, "a\tb "), (4, None), (5, ""), (6, " \n"), (7, "A b"), (8, "a b"), (9, "é" * 3000),
         (10, "é" * 3000), (10, "é" * 3000), (None, "ab"), (None, "zz"), (12, "zz"), (13, "x" * 100_000)] + \
    [(100 + i, "same text") for i in range(50)] + [(300 + i, f"only {i}") for i in range(50)]


def test_exact_groups(spark):
    got = exact_dedup.dedup_against(*exact_dedup.split_snapshot(docs(spark, EXACT)), shard_keys=16).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got), key=repr) == brute_exact(EXACT)


def test_exact_empty_table(spark):
    d = docs(spark, [])
    assert exact_dedup.dedup_against(*exact_dedup.split_snapshot(d)).collect() == []


def test_screen_decides(spark, monkeypatch):
    old, new = docs(spark, [(1, "a b"), (2, "old")]), docs(spark, [(3, "ab"), (4, "n w"), (5, "nw")] + [(10 + i, f"t {i}") for i in range(40)])
    seen = []

    def nothing(keys, snap):
        seen.append(snap.shards)
        return keys.limit(0)

    def groups():
        return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup_against(old, new, 16).filter("doc_id < 10").collect()}
    assert groups() == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False), 4: (4, 2, True), 5: (4, 2, False)}
    monkeypatch.setattr(exact_dedup, "screen", nothing)
    assert groups() == {1: (1, 1, True), 2: (2, 1, True), 3: (3, 1, True), 4: (4, 2, True), 5: (4, 2, False)}
    assert seen == [3]  # 42 digests of the batch, 2 of the snapshot


def test_same_row_on_both_sides_stays_once(spark):
    d = docs(spark, [(1, "a b"), (None, "z")])
    got = exact_dedup.dedup_against(d, d).collect()
    assert sorted(((r["doc_id"], r["group_size"], r["kept"]) for r in got), key=repr) == [(1, 2, False), (1, 2, True), (None, 2, False), (None, 2, True)]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 5000])
def test_fuse_filter(n):
    r = np.random.default_rng(n)
    keys = r.integers(0, 1 << 60, n).astype(np.uint64)
    f = exact_dedup.build_fuse(keys)
    assert exact_dedup.probe_fuse(f, keys).all()
    other = r.integers(1 << 60, 1 << 61, 20000).astype(np.uint64)
    assert exact_dedup.probe_fuse(f, other).mean() < 0.01
    if n == 5000:
        assert len(f[3]) < 1.4 * n


def test_keep_unique_keeps_whole_rows(spark):
    d = docs(spark, EXACT)
    kept = exact_dedup.keep_unique(d)
    assert kept.columns == d.columns
    want = sorted((x[0] for x in brute_exact(EXACT) if x[3]), key=repr)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == want


# -- SimHash --------------------------------------------------------------------------------------

def brute_components(ids_fps, bits):
    fps = sorted({f for _, f in ids_fps})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= bits:
                parent[find(a)] = find(b)
    least = {}
    for d, f in ids_fps:
        least[find(f)] = min(least.get(find(f), 1 << 64), d)
    return {(d, f): least[find(f)] for d, f in ids_fps}


@pytest.mark.parametrize("bits,segments,hot", [(2, 2, 16), (2, 2, 1), (3, 2, 2), (1, 2, 1), (0, 2, 1), (4, 3, 2)])
def test_links_and_components(spark, bits, segments, hot):
    r = random.Random(bits * 10 + hot)
    fps = []
    for _ in range(6):
        base = r.getrandbits(64)
        fps.append(base)
        for _ in range(12):  # chains and stars of near values
            x = r.choice([base, fps[-1]])
            for _ in range(r.randint(0, bits + 1)):
                x ^= 1 << r.randrange(64)
            fps.append(x)
    fps += [0, 1, (1 << 64) - 1]
    signed = [f - (1 << 64) if f >> 63 else f for f in dict.fromkeys(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    pairs = simhash.link(df, bits, segments, hot).collect()
    for p in pairs:
        assert bin((p["a"] ^ p["b"]) & ((1 << 64) - 1)).count("1") <= bits
    if not pairs:
        assert bits == 0
        return
    comp = {x["node"]: x["component"] for x in components(spark.createDataFrame(pairs)).collect()}
    want = brute_components([(f, f) for f in signed], bits)
    assert all(comp.get(f, f) == want[f, f] for f in signed)


def test_fingerprints_brute(spark):
    import xxhash
    rows = [(1, "The quick brown Fox jumps"), (2, "the quick brown fox jumps"), (3, None), (4, ""), (5, " \t"), (6, "one"), (7, "one two"),
            (8, "É é É x y"), (9, "a b c " * 30000), (10, "one"), (10, "one")]

    def brute(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
        return sum(1 << i for i in range(64) if s and 2 * sum(x >> i & 1 for x in h) > len(s))
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {d: format(brute(t), "016x") for d, t in rows}
    assert all(r["fingerprint"] == want[r["doc_id"]] for r in got)
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert comp[2] == 1 and comp[4] == comp[5] == 3 and comp[10] == 6
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_keep_one(spark):
    rows = [(5, "one two three four"), (3, "One two three four"), (3, "One two three four"), (9, "other words are here"), (None, "x y z")]
    got = simhash.keep_one(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == [3, 9, None]


# -- substrings ---------------------------------------------------------------------------------

def brute_substrings(rows, least=100):
    seen, out = {}, []
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0)):
        for i in range(len(t) - least + 1):
            seen.setdefault(t[i:i + least], (d, i))
    for d, t in texts:
        dead = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - least + 1):
            if seen[t[i:i + least]] != (d, i):
                dead[i:i + least] = True
        dead = dead[:len(t)]
        runs = int((dead & ~np.concatenate(([False], dead[:-1]))).sum()) if len(t) else 0
        kept = bytes(x for x, y in zip(t, dead) if not y)
        out.append((d, len(t), int(dead.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def substring_rows():
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh ") for _ in range(400)) for _ in range(5)]
    rows = []
    for i in range(60):
        x, y, a, b = r.choice(base), r.choice(base), r.randint(0, 300), r.randint(0, 300)
        rows.append((i, "".join(r.choice("xyz") for _ in range(r.randint(0, 30))) + x[a:a + r.randint(0, 200)]
                     + "é" * r.randint(0, 3) + y[b:b + r.randint(0, 300)] + "ab" * r.randint(0, 100)))
    return rows + [(200, None), (201, ""), (202, base[0]), (203, base[0]), (203, base[0]), (204, "a" * 5000), (205, "a" * 300),
                   (206, "x" * 99), (207, "x" * 99), (None, base[1]), (208, "no copy " + base[0][:99] + "!")]


@pytest.mark.parametrize("limits", [{}, {"hot_bytes": 300, "block_bytes": 2000}])
def test_substrings(spark, limits):
    rows = substring_rows()
    got = suffix_dedup.dedup_substrings(docs(spark, rows), **limits).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got), key=repr) == brute_substrings(rows)


def test_substrings_of_rows_that_share_an_id(spark):
    r = random.Random(5)

    def text(n):
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared = text(150)
    a, b = text(50) + shared + text(200), text(50) + text(300)
    c = text(50) + shared + text(90)
    rows = [(1, text(400) + shared), (None, a), (None, b), (7, c), (7, text(400)), (8, text(60) + shared), (8, text(60) + shared)]
    got = suffix_dedup.dedup_substrings(docs(spark, rows), texts=True).collect()
    kept = sorted((x["doc_id"] or -1, bytes(x["kept"]).decode()) for x in got)
    assert kept == sorted((d or -1, t if d == 1 else t.replace(shared, "")) for d, t in rows)
    # copies at equal offsets of one id: one of them stays
    two = suffix_dedup.dedup_substrings(docs(spark, [(None, a), (None, c)]), texts=True).collect()
    assert sorted(x["n_removed"] for x in two) == [0, 150]


def test_substrings_of_many_repeated_rows(spark):
    r = random.Random(7)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(6000))
    rows = [(5, text)] * 10_000 + [(9, "other " + text[100:700] + " end"), (3, text[5000:])]
    got = suffix_dedup.dedup_substrings(docs(spark, rows, extra=False).repartition(12)).collect()
    counts = {}
    for x in got:
        key = (x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"])
        counts[key] = counts.get(key, 0) + 1
    want = {x: 1 for x in brute_substrings([(5, text), rows[-2], rows[-1]])}
    assert counts == {x: 10_000 if x[0] == 5 else n for x, n in want.items()}


def test_whole_windows_of_one_anchor_need_no_contents(spark):
    rows = [(1, "b" * 120 + "a" * 400), (2, "a" * 5000), (3, "a" * 100), (4, "x" + "a" * 700 + "y"), (None, "a" * 101)]
    got = suffix_dedup.dedup_substrings(docs(spark, rows), hot_bytes=0).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got), key=repr) == brute_substrings(rows)


def test_substrings_empty_table_and_texts(spark):
    assert suffix_dedup.dedup_substrings(docs(spark, [])).collect() == []
    got = {r["doc_id"]: r["kept"] for r in suffix_dedup.dedup_substrings(docs(spark, [(1, "q" * 100), (2, "p" + "q" * 100)]), texts=True).collect()}
    assert got == {1: b"q" * 100, 2: b"p"}


def test_interval_expansion_kernel():
    r = random.Random(3)
    for trial in range(100):
        least, k = r.choice([3, 5, 8]), r.randint(1, 6)
        cs = [bytes(r.choice(b"ab" if trial % 2 else b"abcd") for _ in range(r.randint(least, 40))) for _ in range(k)]
        doc, start = np.array([r.randint(0, 3) for _ in cs]), np.arange(k) * 100
        w, o = suffix_dedup.repeated_windows(cs, doc, start, least)
        at = {}
        for i, c in enumerate(cs):
            for j in range(len(c) - least + 1):
                at.setdefault(c[j:j + least], []).append((doc[i], start[i] + j, i, j))
        assert set(zip(w.tolist(), o.tolist())) == {x[2:] for v in at.values() for x in v if x[:2] != min(v)[:2]}


# -- what the pipeline keeps: null ids, shared ids, repeated rows ---------------------------------

KEEP = [(1, "aa bb"), (None, "aabb"), (None, "only here"), (2, "aaaaalonger"), (2, "aaaaa longer"), (2, "other text of id two"), (3, "aaaaalonger"),
        (5, "row again"), (5, "row again"), (5, "row again"), (6, "rowagain"), (None, "twice"), (None, "twice"), (None, None), (8, ""), (9, " "),
        (10, "same length a b"), (10, "same length ab "), (11, "z"), (None, "no id no copy")] + [(20, f"shared id {i} of many texts") for i in range(40)]


def test_exact_stage_keeps_the_row_that_stays(spark):
    got = sorted(((r["doc_id"], r["text"]) for r in exact_dedup.keep_unique(docs(spark, KEEP).repartition(3)).collect()), key=repr)
    groups = {}
    for d, t in KEEP:
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), d is None, d or 0, d, t))
    assert len(got) == len(groups)
    for rows in groups.values():
        best = min(x[:3] for x in rows)
        assert any((x[3], x[4]) in got for x in rows if x[:3] == best)
    assert len(set(got)) == len(got)


def test_simhash_stage_keeps_one_row_of_each_component(spark):
    rows = KEEP + [(30, "one two three four five six"), (None, "One two three four five six"), (31, "one two three four five six ")]
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs(spark, rows).repartition(3)).collect()), key=repr)
    prints = [simhash.simhash((t or "").encode()) for _, t in rows]
    left, want = set(range(len(rows))), []
    while left:
        group, new = set(), {left.pop()}
        while new:
            group |= new
            left -= new
            new = {j for j in left if any((prints[i] ^ prints[j]).bit_count() <= 2 for i in new)}
        best = min((rows[i][0] is None, rows[i][0] or 0) for i in group)
        want.append({rows[i] for i in group if (rows[i][0] is None, rows[i][0] or 0) == best})
    assert len(got) == len(want)
    assert all(len(set(got) & group) == 1 for group in want)
