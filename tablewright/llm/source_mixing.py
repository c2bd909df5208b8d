"""Mixing sources to target weights by weighted fair queueing.

A source's target is its weight's share of the budget, at most ``MOST`` times what the source has;
what is cut off there is shared again by weight. Each source's documents are queued in a shuffled
order, ``MOST`` rounds of them. A document's virtual finish time is the number of tokens that its
source has sent by then, divided by the source's target. The queues are merged by finish time,
range-sorted over the cluster, and cut where the total budget is reached.

The shuffled order is that of the MD5 of round, doc_id and text, so any engine can tell it again. Sums
within a source are taken over slices of it (by the first ``SLICE`` digits in each round, each with the
sum of the slices before it), so no source is gathered in a task, whatever its share of the rows.
The merged queue's sums are taken the same way over the parts of the range sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, matched, small_join, text_code

#: Weights by the source's place, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix for each word there is.
BUDGET = 1.5
#: Times that a document can be taken.
MOST = 2
#: Hexadecimal digits of a slice.
SLICE = 3
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """(source, source_size, target) from (source, source_size); a row for each source, so small.

    Sources are weighted by code point order, null last. With r = MOST * size / weight, a source is
    held at its limit if r is below the common level; the level follows from sums over the sources
    with a smaller r.
    """
    place = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    limit = F.lit(float(MOST)) * F.col("source_size")
    rows = sizes.withColumn("w", F.element_at(cycle, F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1)).withColumn("r", limit / F.col("w"))
    order = W.orderBy("r", F.col("source").asc_nulls_last())
    rows = (
        rows.withColumn("below", F.coalesce(F.sum(limit).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("above", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.lit(float(budget)) * F.sum("source_size").over(W.partitionBy()))
        # the level if this source and those after it share what the sources before it leave
        .withColumn("level", (F.col("total") - F.col("below")) / F.col("above"))
    )
    # from the first source that isn't held on, the levels fall
    level = F.max(F.when(F.col("level") <= F.col("r"), F.col("level"))).over(W.partitionBy())
    return rows.select("source", "source_size", F.coalesce(F.least(limit, level * F.col("w")), limit).alias("target"))


def words(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    # what is left when each word is one character and the spaces are gone
    left = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w"), SPACES, "")
    return F.char_length(left).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source, ...).

    Columns: doc_id, size (words), source_size, target (its source's), taken (words that the mix
    takes of it, repeats counted: 0, 1 or 2 times its size). Other columns are ignored.

    A null text has size 0 and takes nothing; null is a source of its own, the last one; rows with
    the same doc_id and text are interchangeable. An empty table gives an empty result. The shuffle
    depends on doc_id and text alone, so runs agree however the input is divided.
    """
    return _mixed(docs, weights, budget).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """The mix itself: the rows of ``docs``, with their columns, each as often as it is taken.

    Documents without words take no room and are left out; otherwise as ``mix``.
    """
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    taken = _mixed(docs, weights, budget).groupBy("doc_id", "code").agg(F.sort_array(F.collect_list(times), False).alias("times"))
    rows = matched(docs, taken).withColumn("times", F.element_at("times", F.col("copy"))).where("times > 0")
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def _mixed(docs: DataFrame, weights: Sequence[float], budget: float) -> DataFrame:
    code = text_code(F.col("text"))
    order = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), code.alias("code"), order.alias("_order"))
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    # one row for each source; the hash groups null with null
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget)
    goals = cut(goals.select(F.xxhash64("source").alias("_s"), "source_size", "target", F.round(F.sum("target").over(W.partitionBy()), 6).alias("total")))
    rounds = F.explode(F.expr(f"sequence(0, {MOST - 1})"))
    queue = rows.where("size > 0").select("_row", "size", F.xxhash64("source").alias("_s"), "_order", rounds.alias("round"))
    queue = queue.withColumn("_h", F.md5(F.concat_ws(":", "round", "_order"))).withColumn("slice", F.substring("_h", 1, SLICE)).drop("_order")
    sums = queue.groupBy("_s", "round", "slice").agg(F.sum("size").alias("n"))
    earlier = W.partitionBy("_s").orderBy("round", "slice").rowsBetween(W.unboundedPreceding, -1)
    # 16 ** SLICE * MOST rows for each source
    starts = sums.select("_s", "round", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = W.partitionBy("_s", "round", "slice").orderBy("_h", "_row").rowsBetween(W.unboundedPreceding, 0)
    timed = queue.withColumn("run", F.sum("size").over(within)).join(starts, ["_s", "round", "slice"])
    timed = small_join(timed, goals.select("_s", "target", "total"), "_s", ["_row", "round"])
    timed = timed.select("_row", "size", "_h", "total", ((F.col("start") + F.col("run")) / F.col("target")).alias("finish"))
    merged = timed.repartitionByRange("finish", "_h", "_row").sortWithinPartitions("finish", "_h", "_row")
    merged = cut(merged.withColumn("part", F.spark_partition_id()))
    parts = merged.groupBy("part").agg(F.sum("size").alias("n"), F.max("total").alias("total"))
    upto = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    # a row for each part of the range sort
    parts = parts.where("start < total")
    run = F.sum("size").over(W.partitionBy("part").orderBy("finish", "_h", "_row").rowsBetween(W.unboundedPreceding, 0))
    whole = parts.where("start + n <= total").select("part")
    border = parts.where("start + n > total").select("part", "start", "total")
    merged = merged.drop("total")
    inside = merged.join(F.broadcast(whole), "part", "left_semi").select("_row", "size")
    edge = merged.join(F.broadcast(border), "part").withColumn("run", run).where("start + run <= total").select("_row", "size")
    taken = inside.unionByName(edge).groupBy("_row").agg(F.sum("size").alias("taken"))
    out = small_join(rows.withColumn("_s", F.xxhash64("source")).join(taken, "_row", "left"), goals, "_s", ["_row"])
    return out.select("doc_id", "code", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
