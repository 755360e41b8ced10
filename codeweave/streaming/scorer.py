"""Score arriving text with Structured Streaming.

Files land in a folder; each micro-batch is chunked (C01, no state needed),
scored by a batch scorer and ranked into supportive chunks per label (A11) in
``foreachBatch``, then written to the batch's own folder of a parquet sink. Stateless, so no watermark;
the checkpoint lives under the session's shared checkpoint folder, so a
restarted query resumes where it stopped."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..operators.aggregate import supportive_chunks
from ..operators.chunk import pack_units


def start_scoring_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str,
                         score_chunks, id_col: str = "id", text_col: str = "text", max_tokens: int = 50,
                         available_now: bool = True):
    """``score_chunks(df(id, chunk_id, text)) -> df(id, chunk_id, label, score)``."""
    stream = spark.readStream.schema(schema).parquet(source)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        units = batch.select(F.col(id_col).alias("id"), sentences(F.col(text_col)).alias("units"))
        chunks = pack_units(units, ["id"], "units", max_tokens)
        scored = score_chunks(chunks.select("id", "chunk_id", "text"))
        best = supportive_chunks(scored, ["id", "chunk_id"])
        # a folder per batch: a batch that is replayed writes the same folder again
        best.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
