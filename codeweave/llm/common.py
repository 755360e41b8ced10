"""Shared helpers of the training-data operators."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Regular-expression class of the white space all contracts share: blank and 0x09-0x0D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: The same characters as bytes; also what ``bytes.split()`` splits on.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet below the shared folder and read it back.
    The files survive lost executors, are computed once and carry statistics."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join whose sides both grow with the corpus: sorted and merged, never broadcast. Spark
    takes an exploded table for as small as the table before, and would gather all of it in the driver."""
    return df.hint("merge")


class Shared:
    """A value that travels inside the task closures."""

    def __init__(self, value):
        self.value = value


def share(spark: SparkSession, value):
    """A bounded value for tasks: a broadcast, or where the session has no SparkContext of its
    own, a part of the closure."""
    try:
        return spark.sparkContext.broadcast(value)
    except AttributeError:
        return Shared(value)


def own_columns(df: DataFrame, **named) -> DataFrame:
    """Only the columns an operator works on, under its own names; columns that are
    missing become typed nulls. Extra columns, also clashing ones, never get in."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f"`{src}`") if src.lower() in have else F.lit(None)).cast(kind).alias(name)
                       for name, (src, kind) in named.items()])


def text_bytes(col: str = "text"):
    """The whole text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def text_key(col: str = "text"):
    """64-bit hash of the whole text (null as empty); with the id it tells rows apart that share an id."""
    return F.xxhash64(text_bytes(col))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole rows of ``docs`` whose id and text key are in ``kept`` (doc_id, txt); null ids are equal.
    Repeated rows of one id and text stay once (any of them). Rows are reduced to one per id and text
    before they are shuffled, and rows without an id are dealt by their text."""
    null = F.lit((1 << 63) - 1)
    d = docs.withColumn("_key", F.coalesce(F.col(f"`{id_col}`"), null)).withColumn("_txt", text_key(f"`{text_col}`"))
    k = kept.select(F.coalesce("doc_id", null).alias("_key"), F.col("txt").alias("_txt")).distinct()
    return d.dropDuplicates(["_key", "_txt"]).join(grown(k), ["_key", "_txt"], "left_semi").drop("_key", "_txt")


def filter_batches(docs: DataFrame, text_col: str, keep) -> DataFrame:
    """Whole rows of ``docs`` for which ``keep(list of texts)`` (null as empty) says true; no shuffle."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep(texts), pa.bool_()))
    at = [c.lower() for c in docs.columns].index(text_col)
    return docs.mapInArrow(run, docs.schema)
