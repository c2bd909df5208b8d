"""What a comparison is asked to do, checked before any job runs."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.rules import Rule

Tolerance = float | Mapping[str, float]


def tolerances(value: Tolerance, name: str, lower: bool) -> dict[str, float]:
    """Tolerances by column, with that of all others under "default"."""
    if isinstance(value, bool) or not isinstance(value, int | float | Mapping):
        raise TypeError(f"{name} must be a number or a mapping of columns to numbers")
    given = dict(value) if isinstance(value, Mapping) else {"default": value}
    out = {"default": 0.0}
    for column, tol in given.items():
        if isinstance(tol, bool) or not isinstance(tol, int | float) or math.isnan(tol):
            raise ValueError(f"{name} of column {column!r} must be a number")
        if tol < 0:
            raise ValueError(f"{name} of column {column!r} cannot be negative")
        out[str(column).lower() if lower else str(column)] = float(tol)
    return out


def key_list(keys: object, lower: bool) -> list[str]:
    """Key columns from one name or several; numbers are taken as names."""
    several = list(keys) if isinstance(keys, Iterable) and not isinstance(keys, str) else [keys]
    if not several or any(k is None for k in several):
        raise ValueError("at least one key column is needed")
    names = [str(k).lower() if lower else str(k) for k in several]
    if len(set(names)) < len(names):
        raise ValueError(f"key columns must be unique: {names}")
    return names


def prepared(df: object, side: str, keys: Sequence[str], lower: bool) -> DataFrame:
    """The table with its column names folded, after checking that it can be compared."""
    if not (hasattr(df, "schema") and hasattr(df, "toDF") and hasattr(df, "isStreaming")):
        raise TypeError(f"{side} must be a Spark DataFrame, not {type(df).__name__}")
    if df.isStreaming:
        raise ValueError(f"{side} is a stream; compare its batches with tablewright.streaming instead")
    names = [c.lower() if lower else c for c in df.columns]
    folded = Counter(n.lower() for n in names)
    if twice := [n for n, k in Counter(names).items() if k > 1]:
        raise ValueError(f"{side} must have unique column names; these occur more than once: {twice}")
    if not lower and (alike := [n for n in names if folded[n.lower()] > 1]):
        raise ValueError(f"{side} has column names that differ in case only: {alike}")
    if missing := [k for k in keys if k not in names]:
        raise ValueError(f"{side} lacks key columns: {missing}")
    return df.toDF(*names)


def _family(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType | T.CharType | T.VarcharType):
        return "string"
    if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType):
        return "date"
    return t.simpleString()


def check_keys(left: T.StructType, right: T.StructType, keys: Sequence[str]) -> None:
    for k in keys:
        a, b = left[k].dataType, right[k].dataType
        if _family(a) != _family(b):
            raise ValueError(f"key column {k!r} is {a.simpleString()} on the left and {b.simpleString()} on the right; cast one of them")
        if isinstance(a, T.MapType | T.VariantType):
            raise ValueError(f"key column {k!r} of type {a.simpleString()} can't be compared")


@dataclass(frozen=True)
class CompareSpec:
    """A checked request. ``unique_keys``: True if the caller knows that no key repeats, None to find out."""

    keys: tuple[str, ...]
    left_name: str
    right_name: str
    abs_tol: dict[str, float]
    rel_tol: dict[str, float]
    ignore_spaces: bool
    ignore_case: bool
    lower_names: bool
    whitespace: str
    rules: tuple[Rule, ...]
    order_by: tuple[str, ...]
    unique_keys: bool | None

    def tolerance(self, column: str) -> tuple[float, float]:
        return tuple(t.get(column, t["default"]) for t in (self.abs_tol, self.rel_tol))
