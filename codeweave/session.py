"""Session helpers: building a session, checkpoint folder, bounded dimensions."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults used when this library builds the session itself (tests, bench).
# On a cluster the caller's session wins: nothing here overrides existing conf.
_LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "codeweave") -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    for k, v in _LOCAL_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("CODEWEAVE_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``. Only a single-machine session
    (master ``local[...]``) may leave it unset and gets a scratch folder; on a
    cluster a machine-local folder would lose data, so that raises."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="codeweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(d)
    except Exception:  # sessions without a classic SparkContext: the conf is enough
        pass
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class DimensionTooLarge(ValueError):
    pass


def bounded_rows(df: DataFrame, max_rows: int, what: str = "dimension") -> list:
    """Collect a *dimension* table (labels, settings, prompts) whose size is bounded
    by construction; refuse, rather than pull, anything larger than ``max_rows``."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise DimensionTooLarge(f"{what} has more than {max_rows} rows; it is not a dimension")
    return rows


class _Value:
    """A value that travels inside the task closures."""

    def __init__(self, value):
        self.value = value


def sent(spark: SparkSession, value):
    """A bounded value for tasks: a broadcast, or where the session has no SparkContext of its own, a part of the closure."""
    try:
        return spark.sparkContext.broadcast(value)
    except Exception:
        return _Value(value)


def dealt(df: DataFrame, *keys: str, times: int = 4) -> DataFrame:
    """Narrow rows that the next step expands a lot: dealt on ``keys`` to ``times`` partitions a core, whatever their
    present size (a small table would be merged into one partition and expanded in one task)."""
    try:
        par = df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # no classic SparkContext: the session's own number of partitions
        par = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(times * par, *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Under-split input (e.g. a text table stored as one row group) would run its
    per-row text work on one core. Only then, hash-repartition on ``keys`` to the
    session parallelism; the hash layout is reused by later per-key windows.
    Large inputs already have many splits and pass through untouched."""
    try:
        par = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= par:
            return df
    except Exception:  # no RDD view of the plan: leave partitioning to the engine
        return df
    return df.repartition(par, *keys) if keys else df.repartition(par)
