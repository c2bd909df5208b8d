"""All statistics of a comparison in one aggregate over one full outer join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Row
from pyspark.sql import functions as F

from ..functions.logic import all_of
from ..functions.rules import max_diff_expr, null_diff_expr
from .align import Aligned


def stats_row(aligned: Aligned, matches: Sequence[Column]) -> Row:
    """One row: common, left_only, right_only, equal_rows, and m{n}, d{n}, z{n} for each common column:
    matching rows, largest distance, rows with a null on one side only.

    ``matches`` are the columns' match expressions, in order. Only keys and common columns are read
    and shuffled; counts are combined before the shuffle of the aggregate.
    """
    both = F.col("in_left") & F.col("in_right")
    every = all_of(matches)
    left_types, right_types = (dict((f.name, f.dataType) for f in df.schema) for df in (aligned.left, aligned.right))
    counts = [
        F.count_if(both).alias("common"),
        F.count_if(F.col("in_right").isNull()).alias("left_only"),
        F.count_if(F.col("in_left").isNull()).alias("right_only"),
        F.count_if(both & every).alias("equal_rows"),
    ]
    for n, match in enumerate(matches):
        x, y = F.col(f"l{n}"), F.col(f"r{n}")
        far = max_diff_expr(x, y, left_types[f"l{n}"], right_types[f"r{n}"])
        counts.append(F.count_if(both & match).alias(f"m{n}"))
        counts.append((F.lit(0.0) if far is None else F.coalesce(F.max(F.when(both, far)), F.lit(0.0))).alias(f"d{n}"))
        counts.append(F.count_if(both & null_diff_expr(x, y)).alias(f"z{n}"))
    return aligned.full().agg(*counts).first()
