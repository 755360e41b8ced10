"""Small tables for the operator tests."""
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators do not know, some named like their own helpers.
EXTRA = ["b", "z", "h", "fp", "key", "kind", "anchor", "sha", "grp", "score", "size", "target", "path", "host", "ranges", "doc"]


def docs(spark, rows, extra=True):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit("x") for c in EXTRA})
    return df


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    syl = ["ba", "ke", "lo", "mi", "nu", "ra", "se", "ti", "vo", "zu", "an", "er", "on"]
    v = ["".join(r.choice(syl) for _ in range(r.randint(1, 4))) for _ in range(vocabulary)]
    return [r.choice(v) for _ in range(n)]
