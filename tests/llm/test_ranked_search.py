"""Ranked search against a plain scorer; the shared nodes must be shared and complete."""
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeweave.llm import ranked_search

from .helpers import docs, words

TERM = re.compile(ranked_search.TERM)


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k=10):
    d = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows if terms(t)]
    n, total = len(d), sum(x[2] for x in d)
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for doc, tf, size in d:
            m = 100 - 75 + 75 * size * n // total
            s = 0
            for t in terms(text):
                df = sum(t in x[1] for x in d)
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def cases():
    r = random.Random(2)
    rows = [(i, " ".join(words(i, r.randint(1, 60), 60))) for i in range(120)]
    rows += [(200 + i, "the same Text, again") for i in range(40)]  # a group of copies: equal scores
    rows += [(300, None), (301, ""), (302, "..."), (None, "same text"), (None, "no id"), (303, "É é É-x_1"), (304, "ba ke lo " * 20000), (305, "dup"), (305, "dup")]
    base = [words(1000 + i, 12, 60) for i in range(8)]
    items = [(i, " ".join(base[i % 8] + words(2000 + i, 5, 60))) for i in range(30)]
    items += [(100, "same text again"), (101, None), (102, "..."), (103, "zzz unknown"), (104, "É X 1"), (105, "dup ba ba ba"), (None, "no id"),
              (106, "the same text"), (106, "the same text"), (107, base[0][0]), (108, " ".join(base[0] * 3))]
    return rows, items


def as_items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({c: F.lit("x") for c in ("item", "node", "term", "n", "a", "b", "rank")})


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_terms, rounds", [(1 << 18, 12), (60, 12), (1 << 18, 1)])
def test_equals_plain_scorer(spark, block_terms, rounds, monkeypatch):
    monkeypatch.setattr(ranked_search, "DOCS", 7)
    rows, items = cases()
    got = ranked_search.search(docs(spark, rows).repartition(5), as_items(spark, items), block_terms=block_terms, rounds=rounds)
    assert found(got) == brute(rows, items)


def test_empty_tables(spark):
    rows, items = cases()
    assert ranked_search.search(docs(spark, []), as_items(spark, items)).collect() == []
    assert ranked_search.search(docs(spark, rows), as_items(spark, [])).collect() == []


def test_shared_sets_are_found_once_and_keep_every_term(spark):
    _, items = cases()
    table = ranked_search.item_terms(as_items(spark, items))
    dag = ranked_search.build_dag(table)
    n = len(dag.leaves)

    def leaves(x):
        return [x] if x < n else [y for z in dag.shared[x - n] for y in leaves(z)]
    term = {i: t.decode() for t, i in dag.terms.items()}
    want = sorted((i, sorted(Counter(terms(t)).items())) for i, t in set(items) if i is not None and terms(t))
    got = sorted((i, sorted((term[dag.leaves[x][0]], dag.leaves[x][1]) for node in nodes for x in leaves(node))) for i, nodes in dag.items if i is not None)
    assert got == want
    users = Counter(x for pair in dag.shared for x in pair) + Counter(x for _, nodes in dag.items for x in nodes)
    assert len(dag.shared) > 20 and all(users[n + i] > 0 for i in range(len(dag.shared)))
    plain = sum(len(Counter(terms(t))) for i, t in set(items))
    assert 2 * len(dag.shared) + sum(len(nodes) for _, nodes in dag.items) < plain
