"""Positions of rows in a sorted table, as a key for tables that have none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import cut


def with_position(df: DataFrame, order_by: Sequence[str], name: str = "position") -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of ``order_by``.

    The table is range-sorted over the cluster; a row's place is the rows in the partitions before
    its own plus its place there, so no task gets the whole table. The sorted rows are written to the
    checkpoint folder: both steps need them, and tied rows must not change places between the two.
    """
    rows = cut(df.orderBy(*order_by).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # a row for each partition
    starts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts.drop("_n")), "_part").withColumn(name, place).select(*df.columns, name)
