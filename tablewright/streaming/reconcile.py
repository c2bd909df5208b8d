"""Reconciling a stream with a reference table, batch by batch.

A comparison needs both tables whole, so a stream isn't compared as such: each of its micro-batches
is, as a bounded table, with ``foreachBatch``. Rows of the reference that a batch lacks aren't
differences; rows of the batch that the reference lacks, or that differ from it, are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.logic import all_of
from ..operators.align import key_column
from ..plans.comparison import Comparison, compare


def reconcile(stream: DataFrame, reference: DataFrame, keys: str | Sequence[str], report: Callable[[Comparison, int], None], checkpoint: str | None = None, **options) -> StreamingQuery:
    """Start a query that calls ``report(comparison, batch_id)`` for each micro-batch of ``stream``.

    The batch is the left side. Before the comparison, the reference is cut to the batch's keys by a
    semi join, in which keys agree as they do in the comparison: null with null, and trimmed if spaces
    are ignored. ``options`` are those of ``compare``; ``checkpoint`` is the query's checkpoint folder.
    """
    if not stream.isStreaming or reference.isStreaming:
        raise ValueError("the first table must be a stream and the second must not")
    names = [keys] if isinstance(keys, str) else list(keys)

    def each(batch: DataFrame, batch_id: int) -> None:
        whole = compare(batch, reference, names, **options)
        asked = whole.left.select(*[key_column(whole.left, k, whole.spec).alias(f"_asked_{n}") for n, k in enumerate(whole.keys)]).distinct()
        same = all_of([key_column(whole.right, k, whole.spec).eqNullSafe(F.col(f"_asked_{n}")) for n, k in enumerate(whole.keys)])
        with whole.with_right(whole.right.join(asked, same, "left_semi")) as comparison:
            report(comparison, batch_id)

    writer = stream.writeStream.foreachBatch(each)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
