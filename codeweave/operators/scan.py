"""Ordered scans over groups of any size: running sums, filled values and previous rows.

A window over one group runs in one task, however long the group is. Here the table is dealt by
ranges of (group, order) to blocks instead; every block is summarised per group, the summaries of
earlier blocks are carried to later ones, and a second pass scans each block from what was carried
to it. Only the first group of a block can have begun in an earlier one, so at most one row per
block is carried, and no task holds more of a group than one block."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BLOCK = "_block"


def written(df: DataFrame, name: str = "table", codec: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: computed once, and kept when executors are lost."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_blocks(df: DataFrame, by: list, order: list, blocks: int | None = None) -> DataFrame:
    """``df`` with its block number; blocks are ranges of (by, order), nulls first, in rising order."""
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    ranged = df.repartitionByRange(blocks, *keys) if blocks else df.repartitionByRange(*keys)
    return written(ranged.withColumn(BLOCK, F.spark_partition_id()), "blocks")


def running(df: DataFrame, by: list, order: list, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
            previous: dict[str, Column] | None = None, blocks: int | None = None) -> DataFrame:
    """``df`` with, per group ``by`` in the order of ``order`` (which should tell rows apart), for each
    name: the sum up to and with the row, the last value that is not null up to and with the row, or
    the value in the row before. Nulls of ``by`` are a group; sums skip nulls, and are 0 before the first value."""
    sums, lasts, previous = sums or {}, lasts or {}, previous or {}
    values = {f"_v_{n}": c for n, c in (sums | lasts | previous).items()}
    b = in_blocks(df.withColumns(values), by, order, blocks)
    at = F.struct(*order)

    def latest(value: Column, name: str):
        # the struct around the value tells a null value from no row
        return F.max_by(F.struct(value.alias("v")), at).alias(name)
    totals = b.groupBy(*by, BLOCK).agg(
        *[F.coalesce(F.sum(f"_v_{n}"), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_c_{n}") for n in lasts],
        *[latest(F.col(f"_v_{n}"), f"_c_{n}") for n in previous])
    earlier = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        F.col(BLOCK).alias("_at"), F.row_number().over(Window.partitionBy(*by).orderBy(BLOCK)).alias("_nth"), *[F.col(c).alias(f"_k_{c}") for c in by],
        *[F.sum(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_c_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in (*lasts, *previous)]).filter("_nth > 1")
    same = F.col(BLOCK) == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    j = b.join(carry, same, "left")
    w = Window.partitionBy(*by, BLOCK).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = [F.col(c) for c in df.columns if c not in sums | lasts | previous]
    out += [(F.coalesce(F.sum(f"_v_{n}").over(upto), F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in sums]
    out += [F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(upto), F.col(f"_c_{n}")).alias(n) for n in lasts]
    first = F.row_number().over(w) == 1
    out += [F.when(first, F.col(f"_c_{n}.v")).otherwise(F.lag(f"_v_{n}").over(w)).alias(n) for n in previous]
    return j.select(*out)


#: Rows of a group that one task may scan.
LONG = 1_000_000


def scanned(df: DataFrame, by: list, order: list, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
            previous: dict[str, Column] | None = None, long_group: int | None = LONG) -> DataFrame:
    """Like :func:`running`. Where no group has more than ``long_group`` rows (counted first) a window per group does,
    with one shuffle; ``None`` says that groups are known to be short, as lines of one input row are."""
    sums, lasts, previous = sums or {}, lasts or {}, previous or {}
    if long_group is not None:
        most = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most > long_group:
            return running(df, by, order, sums, lasts, previous)
    w = Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*[c for c in df.columns if c not in sums | lasts | previous],
                     *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(n) for n, c in sums.items()],
                     *[F.last(c, ignorenulls=True).over(upto).alias(n) for n, c in lasts.items()],
                     *[F.lag(c).over(w).alias(n) for n, c in previous.items()])
