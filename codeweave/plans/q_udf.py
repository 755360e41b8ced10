"""Registered queries: UDF surface (U01, U02) and the streaming scorer."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import udf as U
from ..sources.io import scratch_path
from ..sources.tables import table
from .q_aggregate import pack_sql
from .registry import query, rounded

# One cue word per language for the injected demo scorer.
CUES = [("de", "der"), ("en", "the"), ("es", "el"), ("fr", "le")]


def _u01_sql():
    cnt = lambda k: f"CAST((length(text) - length(replace(text, ' {k} ', ''))) / {len(k) + 2} AS DOUBLE)"  # noqa
    rows = " UNION ALL ".join(f"SELECT doc_id AS id, '{l}' AS label, {cnt(k)} AS z FROM documents" for l, k in CUES)
    return f"""WITH z AS ({rows}),
e AS (SELECT id, label, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM z)
SELECT id, label, round(e / sum(e) OVER (PARTITION BY id), 6) AS score FROM e"""


@query("u01_injected_batch_scorer", _u01_sql())
def u01(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return rounded(U.score_batches(docs, "doc_id", "text", U.keyword_scorer([k for _, k in CUES]), [l for l, _ in CUES]))


@query("u02_batched_map", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def u02(spark, d):
    def fn(b):
        import pandas as pd
        return pd.DataFrame({"doc_id": b["doc_id"], "n_chars": b["text"].str.len().astype("int64")})
    return U.map_batches(table(spark, d, "documents").select("doc_id", "text"), fn, "doc_id long, n_chars long")


@query("u04_streaming_supportive_chunks", None)
def u04(spark, d):
    """Conversations arrive as a file stream (one file per conversation turn set);
    chunks are scored by the distant NB model and ranked per label."""
    from . import experiments as X
    from .q_structure import raw_transcripts  # noqa: F401
    s = X.distant_setup(spark, d)
    src = scratch_path(spark, "stream-in")
    conv = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "turn", "text")
    conv.groupBy("id").agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.struct("turn", "text"))).getField("text")).alias("text")) \
        .write.mode("overwrite").parquet(src)

    def score_chunks(chunks):
        keyed = chunks.select(F.concat_ws(":", "id", "chunk_id").alias("cid"), "id", "chunk_id", "text")
        sc = X.score_texts(s, keyed, "cid", "text")
        return (sc.withColumnRenamed("id", "cid").join(keyed.select("cid", "id", "chunk_id"), "cid")
                .select("id", "chunk_id", "label", "score"))

    from ..streaming.scorer import start_scoring_stream
    sink = scratch_path(spark, "stream-out")
    q = start_scoring_stream(spark, src, "id long, text string", sink, scratch_path(spark, "stream-ckpt"), score_chunks)
    q.awaitTermination()
    return spark.read.parquet(sink).select("id", "chunk_id", "label", F.round("score", 6).alias("score"))


U04_K, U04_TOKENS = 10, 50


def _u04_sql():
    cnt = lambda k: f"CAST((length(text) - length(replace(text, ' {k} ', ''))) / {len(k) + 2} AS DOUBLE)"  # noqa
    rows = " UNION ALL ".join(f"SELECT id, chunk_id, '{l}' AS label, {cnt(k)} AS z FROM chunks" for l, k in CUES)
    return f"""WITH RECURSIVE doc AS (SELECT conv_id AS id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
units AS (SELECT id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS s FROM (SELECT id, regexp_extract_all(text, '{T.SENTENCE}') AS s FROM doc)),
{pack_sql('units', U04_TOKENS)},
z AS ({rows}),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY id, chunk_id)) AS e FROM z),
p AS (SELECT id, chunk_id, label, round(e / sum(e) OVER (PARTITION BY id, chunk_id), 6) AS score FROM e),
b AS (SELECT id, chunk_id, arg_min(label, (-score, label)) AS label, max(score) AS score FROM p GROUP BY id, chunk_id),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id, chunk_id) AS rank FROM b)
SELECT label, CAST(rank AS INTEGER) AS rank, id, chunk_id, score FROM k WHERE rank <= {U04_K}"""


@query("u04_streaming_top_chunks", _u04_sql())
def u04_top(spark, d):
    """Conversations arrive in several files; after the last micro-batch the kept ranking is that of all chunks."""
    from ..streaming.ranking import current_ranking, start_ranking_stream
    src, sink = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    conv = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "turn", "text")
    conv.groupBy("id").agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.struct("turn", "text"))).getField("text")).alias("text")) \
        .repartition(6, "id").write.parquet(src)
    q = start_ranking_stream(spark, src, "id long, text string", sink, scratch_path(spark, "stream-ckpt"),
                             U.keyword_scorer([k for _, k in CUES]), [l for l, _ in CUES], U04_K, max_tokens=U04_TOKENS, files_per_batch=2, digits=6)
    q.awaitTermination()
    return current_ranking(spark, sink, U04_K)
