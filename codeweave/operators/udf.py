"""UDF surface (U01-U03): injected batch scorers and batched column maps.

The scorer is supplied by the caller (a model wrapper, an ONNX session, ...):
``make_scorer()`` is called once per Python worker process and returns a
function ``texts: pandas.Series -> numpy array (n_rows x n_labels)``. Rows move
in Arrow batches (``spark.sql.execution.arrow.maxRecordsPerBatch``); nothing
passes through the driver."""
from __future__ import annotations

from typing import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_batches(df: DataFrame, id_col: str, text_col: str, make_scorer: Callable, labels: list,
                  softmax: bool = True) -> DataFrame:
    """Long scores (id, label, score) from an injected batch scorer."""
    import numpy as np
    import pandas as pd

    lab = list(labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()  # once per task, reused for every batch
        for b in batches:
            if len(b) == 0:
                continue
            z = np.asarray(scorer(b[text_col]), dtype=np.float64)
            if softmax:
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z = z / z.sum(axis=1, keepdims=True)
            n = len(b)
            yield pd.DataFrame({"id": np.repeat(b[id_col].to_numpy().astype(np.int64), len(lab)),
                                "label": np.tile(np.array(lab, dtype=object), n),
                                "score": z.reshape(-1)})

    return df.select(id_col, text_col).mapInPandas(run, "id long, label string, score double")


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Arbitrary pandas function over Arrow batches (``dataset.map(batched=True)``)."""
    def run(batches):
        for b in batches:
            yield fn(b)
    return df.mapInPandas(run, schema)


def keyword_scorer(keywords: list) -> Callable:
    """A small deterministic scorer (counts of ' kw ' per label) used to exercise
    U01 on real text without shipping a model."""
    def make():
        import numpy as np

        def score(texts):
            return np.stack([texts.str.count(" " + k + " ").to_numpy(dtype=np.float64) for k in keywords], axis=1)
        return score
    return make


def score_chunks_best(chunks: DataFrame, make_scorer: Callable, labels: list, digits: int | None = None) -> DataFrame:
    """(id, chunk_id, label, score): each chunk (id, chunk_id, text) with its best label by an injected scorer
    (softmax; ties to the smaller label), row by row, so it also runs inside a stream."""
    import numpy as np
    import pandas as pd

    lab = sorted(labels)
    place = [list(labels).index(x) for x in lab]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for b in batches:
            if len(b) == 0:
                continue
            z = np.asarray(scorer(b["text"]), dtype=np.float64)[:, place]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p = p / p.sum(axis=1, keepdims=True)
            p = p if digits is None else p.round(digits)
            at = p.argmax(axis=1)
            yield pd.DataFrame({"id": b["id"], "chunk_id": b["chunk_id"], "label": np.array(lab, dtype=object)[at], "score": p[np.arange(len(b)), at]})

    return chunks.select(F.col("id").cast("long"), F.col("chunk_id").cast("long"), "text").mapInPandas(run, "id long, chunk_id long, label string, score double")
