"""The best k chunks of every label over all that has arrived, kept in streaming state.

Files land in a folder; every micro-batch is chunked (C01) and scored by an injected scorer (U01) in the
stream itself, each chunk goes to its best label, and keyed state holds the k best chunks of every
(label, salt). State is bounded by labels x salts x k rows however much arrives, and a label that a third of
all chunks get is dealt over the salts. A batch writes the rankings it changed to a folder of its own, so a
batch that is replayed after a failure writes the same folder again; state and progress are in the checkpoint."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..operators.chunk import pack_units
from ..operators.udf import score_chunks_best

SALTS = 8
RANKED = "label string, salt int, id long, chunk_id long, score double"


def start_ranking_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, make_scorer, labels: list,
                         k: int = 10, id_col: str = "id", text_col: str = "text", max_tokens: int = 50, salts: int = SALTS,
                         files_per_batch: int | None = None, digits: int | None = None):
    """Starts the query over the Parquet files of ``source``; it ends when all present files are done. Scores are
    rounded to ``digits`` before they are compared."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    units = reader.parquet(source).select(F.col(id_col).alias("id"), sentences(F.col(text_col)).alias("units"))
    best = score_chunks_best(pack_units(units, ["id"], "units", max_tokens), make_scorer, labels, digits)
    keyed = best.withColumn("salt", F.pmod(F.hash("id", "chunk_id"), F.lit(salts)))

    def keep(key, frames, state):
        import pandas as pd
        rows = list(zip(*state.get)) if state.exists else []
        for f in frames:
            rows += list(zip(f["id"].tolist(), f["chunk_id"].tolist(), f["score"].tolist()))
            rows = sorted(set(rows), key=lambda r: (-r[2], r[0], r[1]))[:k]
        ids, chunks, scores = ([r[i] for r in rows] for i in range(3))
        state.update((ids, chunks, scores))
        yield pd.DataFrame({"label": key[0], "salt": key[1], "id": ids, "chunk_id": chunks, "score": scores})
    ranked = keyed.groupBy("label", "salt").applyInPandasWithState(
        keep, RANKED, "ids array<long>, chunks array<long>, scores array<double>", "update", "NoTimeout")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
    return ranked.writeStream.outputMode("update").foreachBatch(per_batch).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def current_ranking(spark: SparkSession, sink: str, k: int = 10) -> DataFrame:
    """(label, rank, id, chunk_id, score): the ranking after the last batch, from each state's latest rows."""
    rows = spark.read.schema(RANKED + ", batch_id long").parquet(sink)
    last = rows.groupBy("label", "salt").agg(F.max("batch_id").alias("batch_id"))
    now = rows.join(last, ["label", "salt", "batch_id"])
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "id", "chunk_id"))
    return now.withColumn("rank", rank).filter(F.col("rank") <= k).select("label", "rank", "id", "chunk_id", "score")
