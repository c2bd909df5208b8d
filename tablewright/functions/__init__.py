"""Column-level equality rules."""

from .rules import CompareContext, Rule, match_expr, max_diff_expr, null_diff_expr

__all__ = ["CompareContext", "Rule", "match_expr", "max_diff_expr", "null_diff_expr"]
