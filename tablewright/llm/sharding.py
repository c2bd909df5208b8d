"""Sharding by weighted rendezvous hashing.

Each shard draws a pseudo-random score for a record key, and the record goes to the shard with the
highest one. With u uniform in (0, 1) the score is weight / -ln(u), so a shard wins in proportion to
its weight. The score depends on the key and that shard alone: a further shard takes the records
that it wins, and no record moves between the others.

Everything is built-in column expressions. Slots are numbered without gathering a shard: rows are
dealt into ``BUCKETS`` buckets a shard, buckets are counted, and a row's slot is the rows in the
buckets before its own plus its place in its bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Parts of a shard whose rows are numbered apart.
BUCKETS = 1024


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that wins ``key``; a null key is a key like any other."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one at least positive")
    best = []
    for shard, weight in enumerate(weights):
        if weight:
            # 52 bits, never 0 or 1
            u = (F.shiftrightunsigned(F.xxhash64(F.lit(shard).cast("long"), key), 12).cast("double") + 0.5) / F.lit(2.0**52)
            best.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    return -(F.greatest(*best) if len(best) > 1 else best[0])["shard"]


def shard(docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, ...), placed in one of ``shards`` shards.

    Columns: doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law ("key": doc_id and the
    shards' number and weights decide), shard, slot (without gaps from 0 in each shard),
    grown_shard (with one more shard, of weight 1). Other columns are ignored.

    A null text counts as empty, a null doc_id as a key of its own. Repeated rows go to one shard,
    each with a slot. An empty table gives an empty result.
    """
    weights = [1.0] * shards if weights is None else list(weights)
    if len(weights) != shards:
        raise ValueError("as many weights as shards are needed")
    text, key = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, 1.0]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # the row's number is in the hash so that a repeated key is spread over the buckets
    rows = cut(rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(BUCKETS))))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("shard", "_bucket").orderBy("doc_id", "_row")) - 1
    # shards * BUCKETS rows at most, whatever the input
    numbered = rows.withColumn("_place", place).join(F.broadcast(offsets) if shards <= 64 else offsets, ["shard", "_bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_place")).alias("slot"), "grown_shard")
