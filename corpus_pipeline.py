"""Training-corpus pipeline: filter, deduplicate, decontaminate and mix ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before kept; the first
four return whole rows of ``documents``, the last the mix. Part of subpackage ``llm``."""
from __future__ import annotations

from codeweave.llm import decontaminate, exact_dedup, mixing, simhash, toxicity
from codeweave.llm.common import load, stage


def toxicity_stage(spark, docs, sf_dir):
    """Drops the documents that the toxicity operator rejects."""
    return toxicity.keep_clean(docs, load(spark, sf_dir, "labels"))


def exact_dedup_stage(spark, docs, sf_dir):
    """Keeps the document that stays of each group of equal texts."""
    return exact_dedup.keep_unique(docs)


def simhash_stage(spark, docs, sf_dir):
    """Keeps one document of each SimHash component."""
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def decontamination_stage(spark, docs, sf_dir):
    """Drops documents that hold a benchmark item."""
    return decontaminate.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def mixing_stage(spark, docs, sf_dir):
    """Mixes the sources of what is left to their target weights."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: No SQL twin: the toxicity, SimHash and alignment stages cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
