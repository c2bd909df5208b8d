"""Spark-native comparison of two tables."""

from .functions.rules import CompareContext, Rule
from .plans.comparison import ColumnStats, Comparison, RowCounts, compare

__all__ = ["ColumnStats", "CompareContext", "Comparison", "RowCounts", "Rule", "compare"]
__version__ = "0.1.0"
