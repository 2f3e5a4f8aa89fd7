"""Global row index in a total order, without a single-partition window.

``row_number() OVER (ORDER BY k)`` with no partition moves every row into
one task. Instead: range-partition and sort by ``k``, number rows inside
each partition, then add the row count of all earlier partitions. The
offsets table has one row per partition (a proven small bound), so it is
broadcast. The numbered data is checkpointed to the shared checkpoint
folder first: the partition ids come from a nondeterministic expression,
and both the offsets job and the consumer must see the same numbering even
if an executor is lost in between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint_root


def global_index(df: DataFrame, order: Sequence[str], name: str = "rank",
                 partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row under ``order`` (which
    must be a total order for a deterministic answer)."""
    spark = df.sparkSession
    checkpoint_root(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols: list[Column] = [F.col(c) for c in order]
    numbered = (
        df.repartitionByRange(parts, *cols)
        .sortWithinPartitions(*cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mono", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    per_part = numbered.groupBy("_pid").agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_mono").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: a single-partition window here is bounded.
    offsets = per_part.select(
        "_pid", "_first", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_offset"))
    return (
        numbered.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_offset") + (F.col("_mono") - F.col("_first")) + 1)
        .drop("_pid", "_mono", "_first", "_offset")
    )
