"""Helpers shared by the operators: table access and distributed running totals."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import read_table

__all__ = ["cut_lineage", "documents", "read_table", "running_total", "word_count", "buckets_for",
           "by_size", "shared_path", "stored"]

#: words of a text: maximal runs without ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the reliable checkpoint folder."""
    from uuid import uuid4
    from ..session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: cuts the
    lineage like a checkpoint, compressed and readable by column."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_size(texts, chars: int = 1 << 20):
    """The texts of an Arrow array in lists of about ``chars`` characters, so
    that what a task makes of them stays small; a null text stays null."""
    run, size = [], 0
    for t in texts:
        run.append(t.as_py())
        size += len(run[-1] or "")
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def word_count(text) -> F.Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def buckets_for(rows: int, per_bucket: int = 5_000) -> int:
    return max(1, math.ceil(rows / per_bucket))


def running_total(df: DataFrame, group: list[str], bucket: str, order: list, size,
                  out: str, total: str | None = None) -> DataFrame:
    """Exclusive running total of ``size`` per ``group`` in the order
    (``bucket``, ``order``), without sorting a whole group in one task.

    ``bucket`` must be a coarse, order-preserving part of the order.  Only the
    per-bucket totals of a group meet in one task; the rows of a bucket are
    sorted on their own.  ``total`` names a column for the group's sum.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(size).alias("_s"))
    of_group = Window.partitionBy(*group)
    before = of_group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, bucket,
                       F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"),
                       F.sum("_s").over(of_group).alias("_total"))
    inner = (Window.partitionBy(*group, bucket).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, -1))
    ranked = df.withColumn("_in", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    joined = ranked.join(sums, [*group, bucket])
    joined = joined.withColumn(out, F.col("_in") + F.col("_base"))
    if total:
        joined = joined.withColumn(total, F.col("_total"))
    return joined.drop("_in", "_base", "_total")
