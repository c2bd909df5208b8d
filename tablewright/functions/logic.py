"""Conjunctions of many columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(conditions: Sequence[Column]) -> Column:
    """Whether all hold; true if there are none. A balanced tree, so that hundreds of columns pass."""
    if not conditions:
        return F.lit(True)
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return all_of(conditions[:half]) & all_of(conditions[half:])
