"""When two values count as equal, as Column expressions chosen by the types of the two sides.

The first rule that claims a pair of types decides; user rules come before the built-in ones. A pair
that no rule claims is never equal. Dispatch is on ``DataType`` classes, and every expression is one
that passes analysis for its types, with ANSI mode on or off.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What ``whitespace="all"`` strips from both ends; the default strips spaces only.
_BLANKS = r"^\s+|\s+$"


@dataclass(frozen=True)
class CompareContext:
    """What a rule knows besides the two columns."""

    left_type: T.DataType
    right_type: T.DataType
    abs_tol: float = 0.0
    rel_tol: float = 0.0
    ignore_spaces: bool = False
    ignore_case: bool = False
    whitespace: str = "space"
    column: str = ""


class Rule(Protocol):
    """A user rule: a boolean Column for a pair that it decides, or None to leave it to the next rule."""

    def __call__(self, left: Column, right: Column, context: CompareContext) -> Column | None: ...


def _is_date(t: T.DataType) -> bool:
    return isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType)


def _is_string(t: T.DataType) -> bool:
    return isinstance(t, T.StringType | T.CharType | T.VarcharType)


def _is_float(t: T.DataType) -> bool:
    return isinstance(t, T.FloatType | T.DoubleType)


def _comparable(a: T.DataType, b: T.DataType) -> bool:
    """Whether Spark can test the two element types for equality without a cast that may fail."""
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return _comparable(a.elementType, b.elementType)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return len(a) == len(b) and all(x.name == y.name and _comparable(x.dataType, y.dataType) for x, y in zip(a, b, strict=True))
    if isinstance(a, T.MapType | T.VariantType) or isinstance(b, T.MapType | T.VariantType):
        return False
    return a == b or isinstance(a, T.NumericType) and isinstance(b, T.NumericType) or _is_string(a) and _is_string(b)


def normalized(c: Column, context: CompareContext) -> Column:
    """A string as it is compared: trimmed and in upper case, as far as asked for."""
    if context.ignore_spaces:
        c = F.regexp_replace(c, _BLANKS, "") if context.whitespace == "all" else F.trim(c)
    return F.upper(c) if context.ignore_case else c


def array_rule(left: Column, right: Column, context: CompareContext) -> Column | None:
    """Arrays: same length, equal elements in the same order; null elements are equal."""
    a, b = context.left_type, context.right_type
    if not (isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType)):
        return None
    return left.eqNullSafe(right) if _comparable(a, b) else F.lit(False)


def boolean_rule(left: Column, right: Column, context: CompareContext) -> Column | None:
    """Booleans, or a boolean and a number that is exactly 1 or 0."""
    a, b = context.left_type, context.right_type
    if isinstance(a, T.BooleanType) and isinstance(b, T.BooleanType):
        return left.eqNullSafe(right)
    if isinstance(b, T.BooleanType):
        a, b, left, right = b, a, right, left
    if not (isinstance(a, T.BooleanType) and isinstance(b, T.NumericType)):
        return None
    one, zero = F.lit(1).cast("int"), F.lit(0).cast("int")
    return (left.isNull() & right.isNull()) | (left.eqNullSafe(F.lit(True)) & right.eqNullSafe(one)) | (left.eqNullSafe(F.lit(False)) & right.eqNullSafe(zero))


def numeric_rule(left: Column, right: Column, context: CompareContext) -> Column | None:
    """Numbers within ``abs_tol + rel_tol * |right|`` of each other. NaN equals NaN only, null null only.

    Whole numbers without a tolerance are compared exactly; otherwise the distance is a double. A finite
    number is never equal to an infinite one, but infinities of opposite sign lie within any tolerance.
    """
    a, b = context.left_type, context.right_type
    if not (isinstance(a, T.NumericType) and isinstance(b, T.NumericType)):
        return None
    same = left.eqNullSafe(right)
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType) and not context.abs_tol and not context.rel_tol:
        return same
    x, y = left.cast("double"), right.cast("double")
    near = F.abs(x - y) <= F.lit(float(context.abs_tol)) + F.lit(float(context.rel_tol)) * F.abs(y)
    if _is_float(a) or _is_float(b):
        endless = F.lit(float("inf"))
        one_endless = (F.abs(x) == endless) != (F.abs(y) == endless)
        # isnan of null is false
        return F.when(F.isnan(x) & F.isnan(y), True).when(F.isnan(x) | F.isnan(y), False).when(same, True).when(one_endless, False).when(near, True).otherwise(False)
    return F.when(same, True).when(near, True).otherwise(False)


def text_rule(left: Column, right: Column, context: CompareContext) -> Column | None:
    """Strings, dates and timestamps. A string beside a date is read as that date's type."""
    a, b = context.left_type, context.right_type
    if _is_string(a) and _is_string(b):
        return normalized(left, context).eqNullSafe(normalized(right, context))
    if _is_date(a) and _is_date(b):
        return left.eqNullSafe(right)
    if _is_date(a) and _is_string(b):
        a, b, left, right = b, a, right, left
    if not (_is_string(a) and _is_date(b)):
        return None
    read = (normalized(left, CompareContext(a, b, ignore_spaces=True, whitespace=context.whitespace)) if context.ignore_spaces else left).try_cast(b)
    return F.when(left.isNull() & right.isNull(), True).when(left.isNull() | right.isNull(), False).otherwise(F.coalesce(read == right, F.lit(False)))


BUILT_IN: tuple[Rule, ...] = (array_rule, boolean_rule, numeric_rule, text_rule)


def match_expr(left: Column, right: Column, context: CompareContext, rules: Iterable[Rule] = ()) -> Column:
    """A boolean, never null: whether the two sides are equal."""
    for rule in (*rules, *BUILT_IN):
        found = rule(left, right, context)
        if found is not None:
            return F.coalesce(found, F.lit(False))
    return F.lit(False)


def _as_double(c: Column, t: T.DataType) -> Column | None:
    if isinstance(t, T.NumericType | T.BooleanType | T.TimestampType):
        return c.cast("double")
    return c.try_cast("double") if _is_string(t) else None


def max_diff_expr(left: Column, right: Column, left_type: T.DataType, right_type: T.DataType) -> Column | None:
    """The distance of two values that both read as numbers, null otherwise; None if the types never do."""
    x, y = _as_double(left, left_type), _as_double(right, right_type)
    if x is None or y is None:
        return None
    d = F.abs(x - y)
    return F.when(~F.isnan(d), d)


def null_diff_expr(left: Column, right: Column) -> Column:
    return left.isNull() != right.isNull()
