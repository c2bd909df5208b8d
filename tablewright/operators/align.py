"""Aligning two tables on their keys.

Both sides get positional names (``lk0``, ``l0``, ``rk0``, ``r0``, ...), so no user column can clash with
another or with a helper. Keys are compared null-safe. When keys repeat, the n-th row of a key on one
side is paired with the n-th on the other; the number comes from a window and is part of the join
key, which also spreads a hot key over the tasks.

One window task numbers all rows of a key. Keys with more than ``HOT_ROWS`` rows on a side are numbered
apart: their rows are range-sorted over the cluster, and a row's number is its position there less
the first position of its key. Such keys are broadcast if there are at most ``HOT_KEYS``.

The join is a full outer one only for outputs that need both sides' leftovers. Rows of one side
alone come from an anti join, matched rows from an inner join, which Spark can broadcast or split
when skewed; it can do neither for a full outer join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.logic import all_of
from ..functions.rules import _BLANKS, _is_string
from ..plans.spec import CompareSpec
from .position import with_position


#: Rows of a key on one side beyond which its rows aren't numbered in one task.
HOT_ROWS = 1_000_000
#: Hot keys that are broadcast, at most.
HOT_KEYS = 10_000


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def key_column(df: DataFrame, name: str, spec: CompareSpec) -> Column:
    """A key as it is compared: trimmed if spaces are ignored."""
    c = quoted(name)
    if spec.ignore_spaces and _is_string(df.schema[name].dataType):
        return F.regexp_replace(c, _BLANKS, "") if spec.whitespace == "all" else F.trim(c)
    return c


@dataclass(frozen=True)
class KeyFacts:
    """How often the most frequent key occurs on a side, and whether a part of a key is null."""

    most: int = 1
    nulls: bool = True


def key_facts(left: DataFrame, right: DataFrame, spec: CompareSpec) -> KeyFacts:
    """One job over the key columns."""
    sides = []
    for df in (left, right):
        keys = df.select(*[key_column(df, k, spec).alias(f"k{n}") for n, k in enumerate(spec.keys)])
        names = keys.columns
        has_null = ~all_of([F.col(n).isNotNull() for n in names])
        counted = keys.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
        sides.append(counted.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.bool_or(has_null), F.lit(False)).alias("nulls")))
    rows = sides[0].union(sides[1]).collect()
    return KeyFacts(max(r.most for r in rows), any(r.nulls for r in rows))


@dataclass(frozen=True)
class Aligned:
    """Two sides ready to be joined, and where their columns are."""

    left: DataFrame
    right: DataFrame
    on: Column
    keys: tuple[str, ...]
    #: Common columns that aren't keys, in the left table's order; the n-th is l{n} and r{n}.
    common: tuple[str, ...]
    left_columns: dict[str, str]
    right_columns: dict[str, str]

    def full(self) -> DataFrame:
        """Every row of either side, with ``in_left`` and ``in_right``, null where it isn't."""
        return self.left.join(self.right, self.on, "full_outer")

    def both(self) -> DataFrame:
        return self.left.join(self.right, self.on, "inner")

    def left_only(self) -> DataFrame:
        rows = self.left.join(self.right, self.on, "left_anti")
        return rows.select(*[F.col(c).alias(name) for name, c in self.left_columns.items()])

    def right_only(self) -> DataFrame:
        rows = self.right.join(self.left, self.on, "left_anti")
        return rows.select(*[F.col(c).alias(name) for name, c in self.right_columns.items()])


def _numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, hot_rows: int | None) -> DataFrame:
    """``rows`` with the number of each one among those of its key, from 1, in ``order`` or that of the input."""

    def plain(df: DataFrame) -> DataFrame:
        by = [F.col(c) for c in order] or [F.monotonically_increasing_id()]
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*by)))

    if hot_rows is None:
        return plain(rows)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    few_keys = counts.limit(HOT_KEYS + 1).count() <= HOT_KEYS
    sent = F.broadcast if few_keys else lambda df: df  # without the hint, adaptive execution splits hot partitions
    hot = sent(counts.select(*[F.col(k).alias(f"h_{k}") for k in keys]))
    same = all_of([F.col(k).eqNullSafe(F.col(f"h_{k}")) for k in keys])
    cold = plain(rows.join(hot, same, "left_anti"))
    few = rows.join(hot, same, "left_semi")
    if not order:
        few, order = few.withColumn("_in", F.monotonically_increasing_id()), ["_in"]
    few = with_position(few, [*keys, *order], "_at")
    first = sent(few.groupBy(*keys).agg(F.min("_at").alias("_first")).withColumnsRenamed({k: f"h_{k}" for k in keys}))
    few = few.join(first, same).withColumn(name, (F.col("_at") - F.col("_first") + 1).cast("int"))
    return cold.unionByName(few.select(*cold.columns))


def _side(df: DataFrame, spec: CompareSpec, mark: str, common: tuple[str, ...], facts: KeyFacts, hot_rows: int) -> tuple[DataFrame, dict[str, str]]:
    places = {k: f"{mark}k{n}" for n, k in enumerate(spec.keys)} | {c: f"{mark}{n}" for n, c in enumerate(common)}
    others = [c for c in df.columns if c not in places]
    places |= {c: f"{mark}x{n}" for n, c in enumerate(others)}
    keys = [f"{mark}k{n}" for n in range(len(spec.keys))]
    columns = [(key_column(df, c, spec) if c in spec.keys else quoted(c)).alias(places[c]) for c in df.columns]
    rows = df.select(*columns, F.lit(True).alias("in_left" if mark == "l" else "in_right"))
    if facts.most > 1:
        order = [places[c] for c in spec.order_by if c in places]
        rows = _numbered(rows, keys, order, f"{mark}n", hot_rows if facts.most > hot_rows else None)
    return rows, {c: places[c] for c in df.columns}


def align(left: DataFrame, right: DataFrame, spec: CompareSpec, facts: KeyFacts, hot_rows: int = HOT_ROWS) -> Aligned:
    """Sides to join on the keys, and on the rows' numbers if keys repeat."""
    common = tuple(c for c in left.columns if c in right.columns and c not in spec.keys)
    a, left_columns = _side(left, spec, "l", common, facts, hot_rows)
    b, right_columns = _side(right, spec, "r", common, facts, hot_rows)
    same = [F.col(f"lk{n}").eqNullSafe(F.col(f"rk{n}")) if facts.nulls else F.col(f"lk{n}") == F.col(f"rk{n}") for n in range(len(spec.keys))]
    if facts.most > 1:
        same.append(F.col("ln") == F.col("rn"))
    return Aligned(a, b, all_of(same), spec.keys, common, left_columns, right_columns)
