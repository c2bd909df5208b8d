"""Relational operators of a comparison: alignment, statistics, positions."""

from .align import Aligned, KeyFacts, align, key_facts
from .position import with_position
from .stats import stats_row

__all__ = ["Aligned", "KeyFacts", "align", "key_facts", "stats_row", "with_position"]
