import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from tablewright import compare
from tablewright.functions.rules import CompareContext, match_expr

D, TS = dt.date, dt.datetime
NAN, INF = float("nan"), float("inf")


@pytest.fixture(params=[True, False], ids=["ansi", "no ansi"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", str(request.param).lower())
    yield request.param
    spark.conf.set("spark.sql.ansi.enabled", before)


def matches(spark, left, right, pairs, **options):
    df = spark.createDataFrame([(n, a, b) for n, (a, b, _) in enumerate(pairs)], f"id int, a {left}, b {right}")
    ctx = CompareContext(df.schema["a"].dataType, df.schema["b"].dataType, **options)
    got = [r.m for r in df.select("id", match_expr(F.col("a"), F.col("b"), ctx).alias("m")).orderBy("id").collect()]
    assert got == [e for _, _, e in pairs]


CASES = {
    "abs tolerance": ("double", "double", [(1.0, 1.0, True), (2.0, 2.1, True), (3.0, 4.0, False), (4.0, None, False), (None, 4.0, False), (None, None, True), (NAN, NAN, True), (NAN, 1.0, False), (NAN, None, False)], {"abs_tol": 0.2}),
    "relative tolerance is of the right side": ("double", "double", [(100.0, 110.0, True), (110.0, 100.0, False), (0.0, 0.0, True)], {"rel_tol": 0.095}),
    "infinities": ("double", "double", [(INF, INF, True), (-INF, -INF, True), (-INF, INF, True), (INF, -INF, True), (1.0, 0.0, False), (INF, 1.0, False), (1.0, INF, False), (1.0, -INF, False), (INF, None, False), (None, INF, False)], {}),
    "infinities within a tolerance": ("double", "double", [(INF, INF, True), (-INF, INF, True), (INF, 1.0, False), (1.0, INF, False), (-INF, 1.0, False), (1.0, -INF, False)], {"abs_tol": 2.0, "rel_tol": 0.5}),
    "large longs are exact": ("bigint", "bigint", [(2**53, 2**53 + 1, False), (2**53 + 1, 2**53 + 1, True), (None, None, True), (1, None, False)], {}),
    "int and double": ("int", "double", [(1, 1.0, True), (1, 1.5, False), (None, NAN, False)], {}),
    "float and double": ("float", "double", [(0.5, 0.5, True), (NAN, NAN, True)], {}),
    "decimal and double": ("decimal(12,9)", "double", [(Decimal("1.3"), 1.3, True), (Decimal("1.000000004"), 1.000000003, False), (None, None, True)], {}),
    "decimal tolerance": ("decimal(12,9)", "decimal(10,3)", [(Decimal("1.000000004"), Decimal("1"), True), (Decimal("1.1"), Decimal("1"), False)], {"abs_tol": 0.001}),
    "wide decimals don't overflow": ("decimal(38,0)", "decimal(38,0)", [(Decimal(9 * 10**37), Decimal(-9 * 10**37), False), (Decimal(9 * 10**37), Decimal(9 * 10**37), True)], {}),
    "strings": ("string", "string", [("a", "a", True), ("a", "A", False), ("a", " a", False), (None, None, True), ("a", None, False), ("", None, False)], {}),
    "strings without case": ("string", "string", [("a", "A", True), ("é", "É", True), ("a", "b", False)], {"ignore_case": True}),
    "strings without spaces": ("string", "string", [(" a ", "a", True), ("\ta", "a", False), ("a b", "ab", False)], {"ignore_spaces": True}),
    "strings without white space": ("string", "string", [(" \ta\n", "a", True), ("a\tb", "a b", False)], {"ignore_spaces": True, "whitespace": "all"}),
    "strings without both": ("string", "string", [(" A", "a ", True), (None, " ", False)], {"ignore_spaces": True, "ignore_case": True}),
    "dates": ("date", "date", [(D(2020, 1, 1), D(2020, 1, 1), True), (D(2020, 1, 1), D(2020, 1, 2), False), (None, None, True), (None, D(2020, 1, 1), False)], {}),
    "date and timestamp": ("date", "timestamp", [(D(2020, 1, 1), TS(2020, 1, 1), True), (D(2020, 1, 1), TS(2020, 1, 1, 1), False)], {}),
    "date and timestamp, options don't matter": ("date", "timestamp", [(D(2020, 1, 1), TS(2020, 1, 1), True)], {"ignore_spaces": True, "ignore_case": True}),
    "date and plain timestamp": ("date", "timestamp_ntz", [(D(2020, 1, 1), TS(2020, 1, 1), True)], {}),
    "string and date": ("string", "date", [("2020-01-01", D(2020, 1, 1), True), ("2020-01-01 05:06:07", D(2020, 1, 1), True), ("217-01-01", D(2017, 1, 1), False), ("garbage", D(2020, 1, 1), False), ("garbage", None, False), (None, None, True), (None, D(2020, 1, 1), False)], {}),
    "date and string with spaces": ("date", "string", [(D(2020, 1, 1), " 2020-01-01 ", True)], {"ignore_spaces": True}),
    "string and timestamp": ("string", "timestamp_ntz", [("2020-01-01 05:06:07", TS(2020, 1, 1, 5, 6, 7), True), ("x", TS(2020, 1, 1), False)], {}),
    "booleans": ("boolean", "boolean", [(True, True, True), (True, False, False), (None, None, True), (None, False, False)], {}),
    "boolean and int": ("boolean", "int", [(True, 1, True), (False, 0, True), (True, 0, False), (True, 2, False), (None, None, True), (None, 0, False), (False, None, False)], {}),
    "decimal and boolean": ("decimal(38,18)", "boolean", [(Decimal("1.000000000000000001"), True, False), (Decimal(1), True, True), (Decimal(0), False, True)], {}),
    "boolean and bigint": ("boolean", "bigint", [(True, 9007199254740993, False), (True, 1, True)], {}),
    "boolean and string": ("boolean", "string", [(True, "true", False), (None, None, False)], {}),
    "string and number": ("string", "int", [("1", 1, False)], {}),
    "arrays": ("array<int>", "array<int>", [([1, 2], [1, 2], True), ([1, 2], [2, 1], False), ([None], [None], True), ([1], [1, 1], False), (None, None, True), ([], None, False)], {}),
    "arrays of other numbers": ("array<int>", "array<bigint>", [([1], [1], True)], {}),
    "arrays of unlike elements": ("array<int>", "array<string>", [([1], ["1"], False)], {}),
    "array and string": ("array<int>", "string", [([1], "[1]", False)], {}),
    "structs": ("struct<x:int>", "struct<x:int>", [((1,), (1,), False)], {}),
    "maps": ("map<string,int>", "map<string,int>", [({"a": 1}, {"a": 1}, False)], {}),
    "binary": ("binary", "binary", [(b"a", b"a", False)], {}),
    "intervals": ("interval day to second", "interval day to second", [(dt.timedelta(1), dt.timedelta(1), False)], {}),
}


@pytest.mark.parametrize("name", CASES)
def test_truth_table(spark, ansi, name):
    left, right, pairs, options = CASES[name]
    matches(spark, left, right, pairs, **options)


def test_every_pair_of_types_compares(spark, ansi):
    """A full comparison, statistics included, passes for any two types."""
    values = {
        "tinyint": 1, "int": 1, "bigint": 1, "float": 1.0, "double": 1.0, "decimal(38,10)": Decimal(1), "boolean": True, "string": "x", "binary": b"x", "date": D(2020, 1, 1),
        "timestamp": TS(2020, 1, 1), "timestamp_ntz": TS(2020, 1, 1), "array<int>": [1], "array<string>": ["1"], "array<map<string,int>>": [{}], "struct<a:int>": (1,), "map<string,int>": {"a": 1}, "interval day": dt.timedelta(1),
    }
    left = spark.createDataFrame([(1, *[v for _ in values for v in values.values()])], "id int, " + ", ".join(f"c{i}_{j} {t}" for i in range(len(values)) for j, t in enumerate(values)))
    right = spark.createDataFrame([(1, *[v for v in values.values() for _ in values])], "id int, " + ", ".join(f"c{i}_{j} {t}" for i, t in enumerate(values) for j in range(len(values))))
    c = compare(left, right, "id", unique_keys=True)
    assert c.row_counts().common == 1 and all(math.isfinite(s.max_diff) for s in c.column_stats())


def test_max_diff(spark):
    rows = [(1, 1, 1.0, 1.0, "1", "x", 1.0), (2, 2, 2.2, 2.1, "2", "2", 1.0)]
    left = spark.createDataFrame(rows, "id int, whole bigint, floats double, near double, text string, mixed string, inf double")
    right = spark.createDataFrame([(1, 1, 1.0, 1.0, "1", "y", 1.0), (2, 2, 2.0, None, "3", "2.5", INF)], left.schema)
    got = {s.column: (s.max_diff, s.null_diff) for s in compare(left, right, "id").column_stats()}
    assert got["whole"] == (0.0, 0) and got["floats"][0] == pytest.approx(0.2) and got["near"] == (0.0, 1) and got["text"][0] == 1.0 and got["mixed"][0] == 0.5 and got["inf"][0] == INF


def test_user_rules_come_first(spark):
    seen = []

    def by_length(left, right, context):
        seen.append((context.column, context.abs_tol, context.left_type.simpleString()))
        return F.char_length(left) == F.char_length(right) if context.left_type.simpleString() == "string" else None

    left = spark.createDataFrame([(1, "apple", 1), (2, "fig", 2), (3, None, 3)], "id int, value string, n int")
    right = spark.createDataFrame([(1, "grape", 1), (2, "kiwi", 3), (3, None, 3)], "id int, value string, n int")
    stats = {s.column: s.match_cnt for s in compare(left, right, "id", rules=[by_length], abs_tol={"n": 0.5}).column_stats()}
    assert stats == {"id": 3, "value": 1, "n": 2} and ("n", 0.5, "int") in seen
