"""Row numbers and running sums over all rows in order, without a single task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ids of a chunk: a task numbers a chunk, and chunks are numbered by their totals.
CHUNK = 1 << 16


def running(df: DataFrame, order: str, amount: str, name: str, also: list[Column] | None = None) -> DataFrame:
    """Each row with the sum of ``amount`` over the rows before it, by the whole number ``order``.

    Two levels: totals of chunks of ids are summed up first (a row for each chunk), then each chunk on its own.
    """
    chunk = F.floor(F.col(order) / CHUNK)
    rows = df.withColumn("__chunk", chunk)
    totals = rows.groupBy("__chunk").agg(F.sum(amount).alias("__total"))
    bases = totals.select("__chunk", (F.sum("__total").over(Window.orderBy("__chunk")) - F.col("__total")).alias("__base"))
    inner = Window.partitionBy("__chunk").orderBy(order)
    out = rows.withColumn("__upto", F.sum(amount).over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(amount))
    out = out.join(bases, "__chunk")
    return out.withColumn(name, (F.col("__base") + F.col("__upto")).cast("bigint")).drop("__chunk", "__base", "__upto")


def renumbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Each row with its place from 0 by ``order``."""
    return running(df.withColumn("__one", F.lit(1).cast("bigint")), order, "__one", name).drop("__one")
