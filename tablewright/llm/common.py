"""What the corpus operators share: table reading, tables between steps, spread joins, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

from ..sources.scratch import cut
from ..sources.scratch import shared_folder as checkpoint_folder

#: Rows of a key beyond which a join doesn't gather them.
HOT_ROWS = 10_000


def lean(results: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """These batches; Arrow gives what it no longer uses back to the system after each. A worker is
    kept for later tasks, and would keep that memory too."""
    for batch in results:
        yield batch
        pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files lie on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the checkpoint folder and read again, and where it lies."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4()}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``stored`` has written."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_code(text: Column) -> Column:
    """A hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def id_columns(doc_id: Column, kind: DataType) -> tuple[Column, Column]:
    """Whether an id is null, and the id with nulls replaced. Joins and windows on these two share a
    partitioning, which those on a null-safe comparison don't."""
    if isinstance(kind, NumericType):
        return doc_id.isNull(), F.coalesce(doc_id, F.lit(0).cast(kind))
    return doc_id.isNull(), F.coalesce(doc_id.cast("string"), F.lit(""))


def matched(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Join ``docs`` to ``found``, a row for each pair of doc_id and code (a hash of the text).

    The result has all of a document as the struct ``row``, the other columns of ``found``, and
    ``copy``: 1, 2, ... over the rows that agree in doc_id and text. The texts are shuffled once.
    """
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    for_docs, for_found = id_columns(F.col("row.doc_id"), kind), id_columns(F.col("doc_id"), kind)
    rows = rows.withColumns({"_no_id": for_docs[0], "_id": for_docs[1], "_code": text_code(F.col("row.text"))})
    found = found.withColumns({"_no_id": for_found[0], "_id": for_found[1], "_code": F.col("code")}).drop("doc_id", "code")
    keys = ["_code", "_id", "_no_id"]
    copy = F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(0)))
    return rows.join(found, keys).withColumn("copy", copy).drop(*keys)


def spread_join(left: DataFrame, right: DataFrame, on: str | list[str], by: list[str]) -> DataFrame:
    """Inner join on the columns ``on``, which are unique in ``right`` and may be hot in ``left``.

    The rows of a key are dealt by a hash of the columns ``by`` over as many parts as there are
    shuffle partitions, and the key's row of ``right`` goes to those parts that occur. So no task
    gets all rows of a key, and nothing is broadcast or counted beforehand.
    """
    on = [on] if isinstance(on, str) else on
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))
    # at most ``parts`` rows a key, combined before they are shuffled
    heads = left.select(*on, "_part").distinct().join(right, on)
    return left.join(heads, [*on, "_part"]).drop("_part")


#: Rows of a side that is sent to every executor.
BROADCAST_ROWS = 100_000


def small_join(left: DataFrame, right: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Inner join with a side that is usually small and is unique in ``key``.

    ``right`` must be cheap to count, such as a table from ``cut``. It is broadcast if it has at
    most ``BROADCAST_ROWS`` rows; otherwise the join is spread by the columns ``by``.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key)
    return spread_join(left, right, key, by)


def _facts(edges: DataFrame) -> tuple[tuple[int, int | None], int]:
    """What tells these edges from others (their number and an order-free hash), and the highest degree."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    ends = edges.select(F.col("u").alias("node"), h.alias("h")).union(edges.select(F.col("v").alias("node"), F.lit(None).cast("decimal(38,0)").alias("h")))
    nodes = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"))
    row = nodes.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
    return (row[0] or 0, row[1]), row[2] or 0


#: Edges that one task joins, 16 bytes each.
TASK_EDGES = 1_000_000


def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges in ``batches``: each node takes the least label of its neighbours, and the
    label of its label, until nothing changes."""
    held = list(batches)
    u, v = (np.concatenate([np.empty(0, np.int64), *(np.asarray(batch.column(k)) for batch in held)]) for k in (0, 1))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, label = place[: len(u)], place[len(u) :], np.arange(len(nodes))
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            break
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label != (further := label[label])).any():
            label = further
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "root"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """Connected components of ``edges`` (u long, v long) as (node, root), root the smallest node.

    Up to ``task_edges`` edges, which are counted first, are joined in one task. Of more, it
    alternates large-star and small-star steps until the edges stay the same. Each step takes a
    minimum per node, combined before the shuffle, and joins it back; where a node has so many
    edges that this would gather them, the join is spread. The driver only sees counts and a hash. Nodes without an edge to another node don't appear.
    """

    def star(pairs: DataFrame, most: int) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(low, "u") if most <= HOT_ROWS else spread_join(pairs, low, "u", ["v"])

    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges)
    if edges.count() <= task_edges:
        return cut(edges.coalesce(1).mapInArrow(joined, "node long, root long"))
    seen, most = _facts(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, most).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # u > v holds for every row of large, and no node has more rows there than edges
        small = star(large, most)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))
        )
        edges = cut(small.distinct())
        now, most = _facts(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
