"""The prefix trie against a plain one, with sketches that prove nearly all and nearly nothing."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweave.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            dig = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, dig, role, text))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(turns.get(base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        saved = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        leaves = 0 if children[p] else 1
        for q in children[p]:
            s, n = below(q)
            saved, leaves = saved + s, leaves + n
        return saved, leaves
    out = []
    for p, m in members.items():
        saved, leaves = below(p)
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def cases():
    r, rows = random.Random(4), []
    for c in range(130):
        for t in range(r.randint(1, 6)):
            rows.append((c, t, r.choice(["user", "assistant"]), " ".join(r.choice("ab") for _ in range(r.randint(0, 2)))))
    for c in range(400, 480):  # copies
        rows += [(c, t, "user", f"copy turn {t}") for t in range(4)]
    rows += [(600, t, "user", "long conversation word") for t in range(90)] + [(620 + c, t, "user", "long conversation word") for c in range(3) for t in range(60 + c)]
    rows += [(1000 + c, 0, "u", f"one of its own {c}") for c in range(30)]  # many turnless when the base is missing
    rows += [(-3, 0, "u", "minus"), (-20, 0, "u", "base"), (-20, 1, "u", "base b"), (-21, 5, None, None), (-21, None, "u", "null first"), (-21, 5, None, None),
             (700, 1, "u", "x"), (700, 1, "a", "x"), (700, 1, "u", "x"), (None, 0, "u", "no id"), (720, 0, "ab", "c"), (740, 0, "a", "bc"), (760, 0, "u", "t " * 50000)]
    return rows


def as_table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("x") for c in ("depth", "dig", "words", "pos", "len", "l0", "p0", "owner", "kind", "h", "_block")})


def found(spark, rows, **limits):
    got = prefix_trie.trie(*prefix_trie.rebuild(prefix_trie.turn_digests(as_table(spark, rows).repartition(4))), **limits).collect()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in got), key=repr)


@pytest.mark.parametrize("most_cells", [1 << 28, 64, 1])
def test_equals_plain_trie(spark, most_cells, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FLUSH", 50)
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    assert found(spark, cases(), most_cells=most_cells) == brute(cases())


def test_small_tables(spark):
    assert found(spark, []) == []
    for rows in ([(5, 0, "u", "a b")], [(1000, 0, "u", None)], [(None, 0, "u", "x")], [(c, 0, "u", "only first turns") for c in range(1001, 1020)]):
        assert found(spark, rows) == brute(rows)


def test_sketch_never_proves_a_shared_prefix_single(spark):
    r = random.Random(1)
    rows = [(d, *(r.randrange(1 << 32) for _ in range(3))) for d in range(1, 400)]
    rows += rows[:60]
    t = spark.createDataFrame([(i, *x, 0, 0, 0) for i, x in enumerate(rows)], "conv_id long, depth long, l0 long, l1 long, l2 long, p0 long, p1 long, p2 long").repartition(5)
    for cells in (64, 256, 1 << 16):
        n, bits = prefix_trie.sketch(t, len(rows), cells, cells)
        kinds = {(x["conv_id"]): x["kind"] for x in prefix_trie.screen(t.withColumn("depth", F.lit(1)), n, bits).collect()}
        assert all(kinds[i] == 0 for i in (*range(60), *range(399, 459)))
    assert sum(k == 2 for k in kinds.values()) > 330
