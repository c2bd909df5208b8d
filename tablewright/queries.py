"""One query for each operator, over the driver's tables, with the DuckDB SQL of the same result.

Left and right tables are written once, in SQL that both engines read; ``{name}`` stands for a table.
"""

from __future__ import annotations

import contextlib
import importlib.util
import io
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cli import main
from .operators.position import with_position
from .plans.comparison import Comparison, compare
from .report import fixed_width_table
from .sources import load, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: A change of every kind: rows missing on either side, nulls, numbers, dates, case and spaces.
ORDERS_L = "SELECT * FROM {orders} WHERE o_orderkey % 13 <> 0"
ORDERS_R = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
    o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 0.5e0 ELSE 0e0 END AS o_totalprice,
    CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate + INTERVAL '1' DAY ELSE o_orderdate END AS o_orderdate,
    CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) WHEN o_orderkey % 4 = 0 THEN concat('  ', o_orderpriority, ' ') ELSE o_orderpriority END AS o_orderpriority
    FROM {orders} WHERE o_orderkey % 11 <> 0"""
#: (l_orderkey, l_linenumber) repeats; the order within a key is total.
LINES_L = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity FROM {lineitem}"
LINES_R = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
    l_quantity + CASE WHEN l_suppkey % 10 = 0 THEN 1e0 ELSE 0e0 END AS l_quantity FROM {lineitem} WHERE l_partkey % 19 <> 0"""
LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
NULL_KEYS_L = "SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS k, c_custkey AS seq, c_acctbal FROM {customer}"
NULL_KEYS_R = "SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS k, c_custkey AS seq, c_acctbal FROM {customer} WHERE c_custkey % 100 <> 0"
NAMES_L = "SELECT concat(c_name, '') AS k, c_nationkey, c_acctbal FROM {customer}"
NAMES_R = "SELECT CASE WHEN c_custkey % 3 = 0 THEN concat('  ', c_name, ' ') ELSE c_name END AS k, c_nationkey, c_acctbal FROM {customer} WHERE c_custkey % 7 <> 0"
#: Each pair of values that a number rule tells apart, as text: null, NaN, infinities, large and close ones.
NUMBERS = """SELECT CAST(id AS INT) AS id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (VALUES (1, '1', '1'), (2, '2', '2.1'), (3, NULL, NULL), (4, NULL, '1'), (5, '1', NULL),
    (6, 'NaN', 'NaN'), (7, 'NaN', '1'), (8, '1', 'NaN'), (9, 'NaN', NULL), (10, 'Infinity', 'Infinity'), (11, '-Infinity', 'Infinity'), (12, 'Infinity', '-Infinity'), (13, 'Infinity', '1'),
    (14, '1e300', '1.0000001e300'), (15, '0', '-0.0'), (16, '1000', '1000.4'), (17, '1', 'Infinity'), (18, '1', '-Infinity'), (19, '-Infinity', '1'), (20, 'Infinity', NULL), (21, NULL, 'Infinity')) AS t(id, x, y)"""
MIXED = """SELECT CAST(id AS INT) AS id, a, b, CAST(a AS DECIMAL(20, 6)) AS d, CAST(b AS BIGINT) AS n FROM (VALUES (1, 1.5e0, 1e0), (2, 2e0, 2e0), (3, 1.3e0, 3e0), (4, 1.000003e0, 1e0), (5, CAST(NULL AS DOUBLE), 4e0), (6, 7e0, CAST(NULL AS DOUBLE))) AS t(id, a, b)"""


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used) if used else spark.sql(sql)


def duck(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


# ---------------------------------------------------------------- SQL of the oracle


def _order(order: Sequence[str]) -> str:
    return ", ".join(order)


def joined(left: str, right: str, keys: Sequence[str], order: Sequence[str] = ()) -> str:
    """CTEs l, r and j: the full outer join, with the n-th row of a key beside the n-th if ``order`` is given."""
    number = f", row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {_order(order)}) AS occ_" if order else ", 1 AS occ_"
    on = " AND ".join(f"l.{k} IS NOT DISTINCT FROM r.{k}" for k in keys) + " AND l.occ_ = r.occ_"
    return f"WITH l AS (SELECT *, TRUE AS here_{number} FROM ({duck(left)}) s), r AS (SELECT *, TRUE AS here_{number} FROM ({duck(right)}) s), j AS (SELECT l, r, l.here_ AS in_l, r.here_ AS in_r FROM l FULL JOIN r ON {on})"


def equal(c: str) -> str:
    return f"l.{c} IS NOT DISTINCT FROM r.{c}"


def near(c: str, abs_tol: float = 0.0, rel_tol: float = 0.0) -> str:
    return f"({equal(c)} OR coalesce(abs(CAST(l.{c} AS DOUBLE) - CAST(r.{c} AS DOUBLE)) <= {abs_tol} + {rel_tol} * abs(CAST(r.{c} AS DOUBLE)), FALSE))"


def distance(c: str) -> str:
    return f"abs(TRY_CAST(l.{c} AS DOUBLE) - TRY_CAST(r.{c} AS DOUBLE))"


def stats_sql(with_: str, keys: Sequence[tuple[str, str]], columns: Sequence[tuple], only_keys: bool = False, tol: tuple[float, float] = (0, 0)) -> str:
    """Statistics rows; columns are (name, type, type, match, distance or None, rel_tol, abs_tol); ``tol`` is that of keys."""
    out = []
    for k, kind in keys:
        more = "count(*) FILTER (WHERE in_l IS NULL OR in_r IS NULL)" if only_keys else "0"
        out.append(f"SELECT '{k}' AS \"column\", count(*) FILTER (WHERE in_l AND in_r) AS match_cnt, CAST({more} AS BIGINT) AS unequal_cnt, '{kind}' AS dtype1, '{kind}' AS dtype2, {more} = 0 AS all_match, 0e0 AS max_diff, CAST(0 AS BIGINT) AS null_diff, CAST({tol[0]} AS DOUBLE) AS rel_tol, CAST({tol[1]} AS DOUBLE) AS abs_tol FROM j")
    for c, a, b, match, far, rel_tol, abs_tol in columns:
        both = "in_l AND in_r"
        out.append(
            f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {both} AND {match}) AS match_cnt, count(*) FILTER (WHERE {both} AND NOT {match}) AS unequal_cnt, '{a}' AS dtype1, '{b}' AS dtype2, "
            f"{'TRUE' if a == b else 'FALSE'} AND count(*) FILTER (WHERE {both} AND NOT {match}) = 0 AS all_match, "
            f"{f'coalesce(max({far}) FILTER (WHERE {both} AND NOT isnan({far})), 0e0)' if far else '0e0'} AS max_diff, "
            f"count(*) FILTER (WHERE {both} AND (l.{c} IS NULL) <> (r.{c} IS NULL)) AS null_diff, CAST({rel_tol} AS DOUBLE) AS rel_tol, CAST({abs_tol} AS DOUBLE) AS abs_tol FROM j"
        )
    return with_ + " " + " UNION ALL ".join(out)


ORDERS_J = joined(ORDERS_L, ORDERS_R, ["o_orderkey"])
ORDER_COLUMNS = ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def order_columns(price: str | None = None, priority: str | None = None, tol: tuple[float, float] = (0, 0)) -> list[tuple]:
    """The orders' columns for ``stats_sql``; price and priority with their own match, tol is (rel, abs)."""
    kinds = {"o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
    matches = {c: equal(c) for c in kinds} | {"o_totalprice": price or near("o_totalprice")} | ({"o_orderpriority": priority} if priority else {})
    return [(c, k, k, f"({matches[c]})", None if k == "timestamp_ntz" else distance(c), *tol) for c, k in kinds.items()]


def orders_stats(**options) -> str:
    return stats_sql(ORDERS_J, [("o_orderkey", "bigint")], order_columns(**options), tol=options.get("tol", (0, 0)))


EVERY_ORDER = " AND ".join(f"({near(c) if c == 'o_totalprice' else equal(c)})" for c in ORDER_COLUMNS)
COUNTS = "count(*) FILTER (WHERE in_l AND in_r) AS common, count(*) FILTER (WHERE in_r IS NULL) AS left_only, count(*) FILTER (WHERE in_l IS NULL) AS right_only"


# ---------------------------------------------------------------- queries


def orders(spark: SparkSession, sf_dir: str, **options) -> Comparison:
    return compare(rows(spark, sf_dir, ORDERS_L), rows(spark, sf_dir, ORDERS_R), "o_orderkey", unique_keys=True, **options)


def counts_frame(spark: SparkSession, c: Comparison) -> DataFrame:
    r = c.row_counts()
    return spark.createDataFrame([(r.common, r.left_only, r.right_only, r.equal, r.unequal)], "common long, left_only long, right_only long, equal_rows long, unequal_rows long")


def row_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_frame(spark, orders(spark, sf_dir))


def matched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, left_name="a", right_name="b").matched()


def key_only(spark: SparkSession, sf_dir: str) -> Comparison:
    keys = "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderkey % "
    return compare(rows(spark, sf_dir, keys + "13 <> 0"), rows(spark, sf_dir, keys + "11 <> 0"), ["o_orderkey", "o_custkey"])


def lines(spark: SparkSession, sf_dir: str) -> Comparison:
    return compare(rows(spark, sf_dir, LINES_L), rows(spark, sf_dir, LINES_R), LINE_KEYS, order_by=LINE_ORDER)


def pairs(spark: SparkSession, sf_dir: str, left: str, right: str, keys, **options) -> Comparison:
    return compare(rows(spark, sf_dir, left), rows(spark, sf_dir, right), keys, left_name="a", right_name="b", **options)


def _matches(c: Comparison) -> DataFrame:
    return c.matched()


DATES_L = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderdate AS t FROM {orders}"
DATES_R = "SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN 'garbage' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) END AS d, CAST(CAST(o_orderdate AS DATE) AS DATE) AS t FROM {orders}"
BOOLS_L = "SELECT doc_id, toxic AS x, toxic = 1 AS y, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality = 1 END AS z FROM {labels}"
BOOLS_R = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN toxic <> 1 ELSE toxic = 1 END AS x, CASE WHEN doc_id % 4 = 0 THEN toxic + 1 ELSE toxic END AS y, quality = 1 AS z FROM {labels}"
VECTORS_L = "SELECT vec_id, embedding FROM {embeddings}"
VECTORS_R = "SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN {reverse}(embedding) ELSE embedding END AS embedding FROM {embeddings}"
TYPES_L = "SELECT o_orderkey, o_custkey AS n, o_orderstatus AS s, o_totalprice AS p FROM {orders}"
TYPES_R = "SELECT o_orderkey, CAST(o_custkey AS INT) AS n, CAST(o_custkey AS DOUBLE) AS s, CAST(o_totalprice AS VARCHAR(30)) AS p FROM {orders}"
EXTRA_L = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS price, o_orderdate AS day FROM {orders}"
EXTRA_R = "SELECT o_orderstatus, o_orderkey, o_orderpriority, o_custkey FROM {orders}"
SCALE_R = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 1.000002e0 AS o_totalprice, o_orderdate, o_orderpriority FROM {orders}"
WORDS = "SELECT * FROM (VALUES (1, 'abc', 'xyz'), (2, 'abcd', 'xy'), (3, NULL, NULL), (4, NULL, 'a'), (5, '3', '5.5'), (6, 'x', '2')) AS t(id, a, b)"
LENGTHS_L = "SELECT p_partkey, p_name, p_brand FROM {part}"
LENGTHS_R = "SELECT p_partkey, reverse(p_name) AS p_name, CASE WHEN p_partkey % 5 = 0 THEN concat(p_brand, '!') ELSE reverse(p_brand) END AS p_brand FROM {part}"


def same_length(left, right, context):
    """A user rule: strings of the same length are equal."""
    if context.left_type.simpleString() == context.right_type.simpleString() == "string":
        return F.char_length(left).eqNullSafe(F.char_length(right))
    return None


def numbers(spark: SparkSession, abs_tol: float, rel_tol: float) -> DataFrame:
    table = spark.sql(NUMBERS)
    c = compare(table.selectExpr("id", "x AS v"), table.selectExpr("id", "y AS v"), "id", left_name="a", right_name="b", abs_tol=abs_tol, rel_tol=rel_tol)
    return c.matched().select(F.col("id_a").alias("id"), "v_match")


def numbers_sql(abs_tol: float, rel_tol: float) -> str:
    # infinities of opposite sign are equal, as in the engine: NaN is the highest number in both
    return f"""SELECT id, CASE WHEN isnan(x) AND isnan(y) THEN TRUE WHEN coalesce(isnan(x), FALSE) OR coalesce(isnan(y), FALSE) THEN FALSE WHEN x IS NOT DISTINCT FROM y THEN TRUE
        WHEN x IS NULL OR y IS NULL THEN FALSE WHEN isinf(x) <> isinf(y) THEN FALSE ELSE abs(x - y) <= CAST({abs_tol} AS DOUBLE) + CAST({rel_tol} AS DOUBLE) * abs(y) END AS v_match FROM ({NUMBERS})"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = rows(spark, sf_dir, "SELECT * FROM {orders}")
    fewer = whole.where("o_orderkey % 11 <> 0")
    changed = whole.withColumn("o_custkey", F.expr("CASE WHEN o_orderkey % 1000 = 0 THEN -1 ELSE o_custkey END"))
    cases = {"same": (whole, whole), "fewer": (whole, fewer), "changed": (whole, changed), "narrow": (whole, whole.drop("o_orderdate")), "empty": (whole.limit(0), whole.limit(0))}
    out = []
    for name, (a, b) in cases.items():
        c = compare(a, b, "o_orderkey", unique_keys=True)
        out.append((name, c.matches(), c.matches(True), c.is_subset(), c.all_columns_match(), c.all_rows_overlap(), c.common_rows_match()))
    return spark.createDataFrame(out, "scenario string, matches boolean, matches_ignoring_columns boolean, is_subset boolean, columns_match boolean, rows_overlap boolean, common_match boolean")


def threshold_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = orders(spark, sf_dir)
    n = c.row_counts().unequal
    return spark.createDataFrame([(c.within(n), c.within(n, True), c.within(n - 1, True), c.within(n + c.row_counts().left_only + c.row_counts().right_only))], "at_unequal boolean, ignoring_unique boolean, one_less boolean, all_counted boolean")


def extra_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = compare(rows(spark, sf_dir, EXTRA_L), rows(spark, sf_dir, EXTRA_R), "o_orderkey")
    lists = (("common", c.common_columns()), ("left", c.left_only_columns()), ("right", c.right_only_columns()))
    return spark.createDataFrame([(side, n, name) for side, names in lists for n, name in enumerate(names)], "side string, place int, name string")


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = orders(spark, sf_dir, left_name="a", right_name="b")
    c.hide(["o_custkey", "O_TOTALPRICE"])
    return c.mismatches()


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = orders(spark, sf_dir).shapes()
    return spark.createDataFrame([("left", *a), ("right", *b)], "side string, n_rows long, n_columns int")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text, but for the samples, which ``report_samples`` has."""
    text = orders(spark, sf_dir).report(sample_count=0)
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "n int, line string")


def report_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that the report's samples show, in its order."""
    c = orders(spark, sf_dir)
    found = c.samples(c.columns_with_mismatches(), 4)
    rows = [(name, n, *map(str, r)) for name, some in found.items() for n, r in enumerate(some)]
    return spark.createDataFrame(rows, "column string, n int, o_orderkey string, left_value string, right_value string")


def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s.column, s.match_rate) for s in orders(spark, sf_dir).column_stats()], "column string, match_rate double")


def column_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders(spark, sf_dir).report_data(sample_count=0).column_comparison
    return spark.createDataFrame([(t.unequal_columns, t.equal_columns, t.unequal_values)], "unequal_columns long, equal_columns long, unequal_values long")


def sorted_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = orders(spark, sf_dir).report_data(sample_count=0).mismatch_stats
    return spark.createDataFrame([(n, s.column, s.unequal_cnt, m.has_samples) for n, s in enumerate(m.stats)], "n int, column string, unequal_cnt long, has_samples boolean")


def json_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the JSON report, read back from its text."""
    d = json.loads(orders(spark, sf_dir).report_data(sample_count=0).to_json())
    out = [(f"{part}.{k}", v) for part in ("column_summary", "row_summary", "column_comparison") for k, v in d[part].items() if isinstance(v, int) and not isinstance(v, bool)]
    return spark.createDataFrame([*out, *[(f"{side}.{n}", v) for side in ("df1_shape", "df2_shape") for n, v in enumerate(d[side])]], "item string, n long")


def html_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's frame, and that the text in it is escaped."""
    whole = rows(spark, sf_dir, "SELECT o_orderkey, '<b>&' AS s FROM {orders}")
    c = compare(whole, whole.withColumn("s", F.lit("x")), "o_orderkey", left_name="a<b", right_name="c")
    page = c.report_data(sample_count=2).to_html()
    return spark.createDataFrame([(page[:6], page[-7:], "a&lt;b" in page, "&lt;b&gt;&amp;" in page, "<b>" in page)], "head string, tail string, name boolean, cell boolean, raw boolean")


def plain_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text tables, one with uneven rows, which is refused."""
    try:
        fixed_width_table(["a", "b"], [["x"]], "lr")
        refused = "no"
    except ValueError:
        refused = "yes"
    lines = [*fixed_width_table(["name", "n"], [["a", "1,000"], ["long one", 7]], "lr").split("\n"), *fixed_width_table(["a"], [], "l").split("\n"), refused]
    return spark.createDataFrame(list(enumerate(lines)), "n int, line string")


def long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long names are cut in the report's table."""
    side = lambda n: rows(spark, sf_dir, "SELECT n_nationkey, n_nationkey + {} AS a_column_of_twenty__x, n_nationkey + {} AS another_column_of_over_20 FROM {{nation}}".format(n, n))
    text = compare(side(0), side(1), "n_nationkey").report(sample_count=0)
    return spark.createDataFrame([(x.split("  ")[0],) for x in text.split("\n") if x.startswith("a")], "name string")


def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names of either case, folded or kept."""
    left, right = rows(spark, sf_dir, "SELECT n_nationkey AS ID, n_name AS Name FROM {nation}"), rows(spark, sf_dir, "SELECT n_nationkey AS Id, n_name AS name FROM {nation}")
    folded = compare(left, right, "iD")
    kept = compare(left, right.withColumnRenamed("Id", "ID"), "ID", lower_names=False)
    out = [("folded", c.matches(), ",".join(c.common_columns()), ",".join(c.left_only_columns())) for c in [folded]]
    out += [("kept", c.matches(), ",".join(c.common_columns()), ",".join(c.left_only_columns())) for c in [kept]]
    return spark.createDataFrame(out, "names string, matches boolean, common string, left_only string")


def revealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = orders(spark, sf_dir, left_name="a", right_name="b")
    c.hide(["o_custkey"])
    c.reveal()
    return c.mismatches()


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused, and how."""
    table = rows(spark, sf_dir, "SELECT * FROM {nation}")

    def twice() -> None:
        c = compare(table, table, "n_nationkey")
        c.hide(["n_name"])
        c.hide(["n_name"])

    calls = {
        "unknown sample": lambda: compare(table, table, "n_nationkey").sample("nope"),
        "hidden twice": twice,
        "hidden named twice": lambda: compare(table, table, "n_nationkey").hide(["n_name", "N_NAME"]),
        "hidden number": lambda: compare(table, table, "n_nationkey").hide([1]),
        "missing key": lambda: compare(table, table, "nope"),
        "same names": lambda: compare(table, table, "n_nationkey", left_name="x", right_name="x"),
        "negative tolerance": lambda: compare(table, table, "n_nationkey", abs_tol=-1),
        "tolerance of text": lambda: compare(table, table, "n_nationkey", abs_tol="1"),
        "no table": lambda: compare(table, [1], "n_nationkey"),
        "unknown template": lambda: compare(table, table, "n_nationkey").report(template="no_such_template"),
    }

    def refused(call: Callable[[], object]) -> str:
        try:
            call()
        except (ValueError, TypeError, FileNotFoundError, RuntimeError) as error:
            return type(error).__name__
        return "none"

    return spark.createDataFrame([(name, refused(call)) for name, call in calls.items()], "call string, error string")


def tolerant_rule(left, right, context):
    """A user rule that reads its context: doubles within the column's tolerance, and a tenth more."""
    if context.left_type.simpleString() == "double":
        return F.abs(left - right) <= F.lit(context.abs_tol * 1.1)
    return None


def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as one JSON array over many lines, read and compared with the table it came from."""
    table = rows(spark, sf_dir, "SELECT n_nationkey, n_name, n_regionkey FROM {nation}")
    lines = [json.dumps(r.asDict()) for r in table.orderBy("n_nationkey").collect()]  # 25 nations at every scale
    path = f"{_scratch(spark)}/nation.json"
    spark.createDataFrame([("[\n" + ",\n".join(lines) + "\n]",)], "value string").coalesce(1).write.text(path)
    c = compare(table, load(spark, path), "n_nationkey")
    return spark.createDataFrame([(c.matches(), c.row_counts().common)], "matches boolean, common long")


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by names of one, two and three parts."""
    name = f"tablewright_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{_scratch(spark)}'")
    try:
        spark.sql(f"CREATE TABLE {name}.a USING parquet LOCATION '{sf_dir}/customer.parquet'")
        spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView(name)
        out = []
        for left, right in ((name, f"{name}.a"), (f"{name}.a", f"spark_catalog.{name}.a")):
            c = compare(left, load(spark, right) if right.count(".") == 2 else right, "c_custkey", right_name="other", spark=spark)
            out.append((left.count(".") + 1, right.count(".") + 1, c.spec.left_name == left.rsplit(".")[-1], c.matches(), c.row_counts().common))
        return spark.createDataFrame(out, "left_parts int, right_parts int, named boolean, matches boolean, common long")
    finally:
        spark.catalog.dropTempView(name)
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def cli_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes by flags. The right side is a table with fewer rows and changed prices."""
    folder = _scratch(spark)
    left, right = f"{folder}/left.parquet", f"{folder}/right.csv"
    rows(spark, sf_dir, "SELECT s_suppkey, s_name, s_acctbal FROM {supplier}").write.parquet(left)
    rows(spark, sf_dir, "SELECT s_suppkey AS S_SUPPKEY, CASE WHEN s_suppkey = 3 THEN concat(' ', lower(s_name)) ELSE s_name END AS s_name, s_acctbal + 0.5e0 AS s_acctbal, 1 AS extra FROM {supplier} WHERE s_suppkey <> 7").write.option("sep", "|").option("header", True).csv(right)
    base = ["--left", left, "--right", right, "--csv-delimiter", "|"]
    one = [*base, "--on", "s_suppkey"]
    loose = ["--ignore-extra-columns", "--abs-tol", "s_acctbal=0.6", "--ignore-spaces", "--ignore-case"]
    calls = {
        "plain": one,
        "loose": [*one, *loose],
        "loose, one row": [*one, *loose, "--max-unequal-rows", "1"],
        "loose, unique ignored": [*one, *loose, "--max-unequal-rows", "0", "--ignore-unique-rows"],
        "tight tolerance": [*one, "--ignore-extra-columns", "--abs-tol", "0.4", "--ignore-spaces", "--ignore-case", "--max-unequal-rows", "0", "--ignore-unique-rows"],
        "relative tolerance": [*one, "--ignore-extra-columns", "--rel-tol", "1e9", "--ignore-spaces", "--ignore-case", "--max-unequal-rows", "0", "--ignore-unique-rows"],
        "case kept": [*one, *loose, "--no-cast-column-names-lower"],
        "wrong format": [*one, "--input-format", "parquet"],
        "names": [*one, *loose, "--df1-name", "x", "--df2-name", "y", "--spark-app-name", "z", "--no-cache-intermediates", "--backend", "spark", "--max-unequal-rows", "1"],
        "equal names": [*one, "--df1-name", "x", "--df2-name", "x"],
        "by place": ["--left", left, "--right", left, "--on-index", "--order-by", "s_suppkey"],
        "place without order": [*base, "--on-index"],
        "key and place": [*one, "--on-index", "--order-by", "s_suppkey"],
        "no key": base,
        "mixed tolerances": [*one, "--abs-tol", "1", "--abs-tol", "s_acctbal=1"],
        "unwritable": [*one, "--output", f"{sf_dir}/nation.parquet/x"],
    }
    quiet = io.StringIO()
    with contextlib.redirect_stderr(quiet):
        found = [(name, main(["compare", "--quiet", *argv])) for name, argv in calls.items()]
    return spark.createDataFrame(found, "call string, exit_code int")


def cli_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command prints in each format."""
    argv = ["compare", "--left", f"{sf_dir}/nation.parquet", "--right", f"{sf_dir}/nation.parquet", "--on", "n_nationkey,n_name", "--sample-count", "1", "--column-count", "2"]
    out = []
    for kind in ("text", "json", "html"):
        printed = io.StringIO()
        with contextlib.redirect_stdout(printed):
            code = main([*argv, "--report-format", kind])
        text = printed.getvalue()
        found = json.loads(text)["row_summary"]["common_rows"] if kind == "json" else int(text.split("rows in common: ")[1].split("\n")[0])
        out.append((kind, code, found, "nation_1" in text and "nation_2" in text))
    return spark.createDataFrame(out, "format string, exit_code int, common long, named boolean")


def report_row_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = orders(spark, sf_dir).report_data(sample_count=2).to_dict()
    return spark.createDataFrame([(k, int(v)) for k, v in d["row_summary"].items() if k.endswith("rows") or k.endswith("unique")], "item string, n long")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4()}"


def file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each format is written and read again, and compared with the table it came from."""
    table = rows(spark, sf_dir, "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM {customer}")
    folder, out = _scratch(spark), []
    for kind, suffix in (("csv", "csv"), ("parquet", "parquet"), ("json", "jsonl"), ("parquet", "pq")):
        path = f"{folder}/customer.{suffix}"
        table.write.format(kind).option("header", True).save(path)
        c = compare(table, load(spark, path), "c_custkey", unique_keys=True)
        out.append((suffix, c.matches(), c.row_counts().common))
    return spark.createDataFrame(out, "format string, matches boolean, common long")


def cli_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = f"{sf_dir}/orders.parquet", f"{sf_dir}/customer.parquet"
    calls = {"same": ["--left", a, "--right", a, "--on", "o_orderkey"], "bad key": ["--left", a, "--right", b, "--on", "o_orderkey"], "missing file": ["--left", a, "--right", f"{sf_dir}/none.parquet", "--on", "x"]}
    return spark.createDataFrame([(name, main(["compare", "--quiet", *argv])) for name, argv in calls.items()], "call string, exit_code int")


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a comparison that keeps its matched rows, after these have been used."""
    with orders(spark, sf_dir, cache=True) as c:
        c.mismatches().count()
        return counts_frame(spark, c)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables without a key, compared by position."""
    a = with_position(rows(spark, sf_dir, "SELECT c_acctbal, c_custkey FROM {customer}"), ["c_acctbal", "c_custkey"])
    b = with_position(rows(spark, sf_dir, "SELECT c_acctbal, c_custkey FROM {customer} WHERE c_custkey % 40 <> 7"), ["c_acctbal", "c_custkey"])
    return counts_frame(spark, compare(a, b, "position", unique_keys=True))


def _both_sql(left: str, right: str, keys: Sequence[str], select: str, where: str = "") -> str:
    return f"{joined(left, right, keys)} SELECT {select} FROM j WHERE in_l AND in_r {where}"


def _reversed(sql: str, name: str) -> str:
    return sql.replace("{reverse}", name)


def _anti(a: str, b: str, columns: str = "*") -> str:
    return f"SELECT {columns} FROM ({duck(a)}) l WHERE NOT EXISTS (SELECT 1 FROM ({duck(b)}) r WHERE l.o_orderkey IS NOT DISTINCT FROM r.o_orderkey)"


PAIRS = ", ".join(f"l.{c} AS {c}_a, r.{c} AS {c}_b" for c in ORDER_COLUMNS)
KEYS_13, KEYS_11 = (f"SELECT o_orderkey, o_custkey FROM {{orders}} WHERE o_orderkey % {n} <> 0" for n in (13, 11))
KEY_J = joined(KEYS_13, KEYS_11, ["o_orderkey", "o_custkey"])
SCALED_J = joined("SELECT * FROM {orders}", SCALE_R, ["o_orderkey"])
ALIKE = "upper(l.o_orderpriority) IS NOT DISTINCT FROM upper(r.o_orderpriority)"
TRIMMED = "trim(l.o_orderpriority, ' ') IS NOT DISTINCT FROM trim(r.o_orderpriority, ' ')"
BOTH = "upper(trim(l.o_orderpriority, ' ')) IS NOT DISTINCT FROM upper(trim(r.o_orderpriority, ' '))"
LINE_J = joined(LINES_L, LINES_R, LINE_KEYS, LINE_ORDER)
TRIM_J = joined(NAMES_L.replace("concat(c_name, '')", "trim(c_name, ' ')"), f"SELECT trim(k, ' ') AS k, c_nationkey, c_acctbal FROM ({NAMES_R})", ["k"])
EQUAL_COUNTS = "common, left_only, right_only, equal_rows, common - equal_rows AS unequal_rows"


def _counted(with_: str, every: str) -> str:
    return f"{with_} SELECT {EQUAL_COUNTS} FROM (SELECT {COUNTS}, count(*) FILTER (WHERE in_l AND in_r AND {every}) AS equal_rows FROM j)"


def text_table(headers: Sequence[str], source: str, align: str) -> str:
    """SQL for (o, line) of a text table; ``source`` has strings c0, c1, ... and o, from 1, that orders them."""
    names = [f"c{n}" for n in range(len(headers))]
    every = f"SELECT 0 AS o, {', '.join(f'{chr(39)}{h}{chr(39)} AS {c}' for h, c in zip(headers, names, strict=True))} UNION ALL SELECT o, {', '.join(names)} FROM ({source})"
    widths = ", ".join(f"max(length({c})) OVER () AS w_{c}" for c in names)
    line = " || '  ' || ".join(f"{'rpad' if a == 'l' else 'lpad'}({c}, CAST(w_{c} AS INT), ' ')" for a, c in zip(align, names, strict=True))
    dashes = " || '  ' || ".join(f"repeat('-', w_{c})" for c in names)
    return f"SELECT CASE WHEN d THEN 0.5 ELSE o END AS o, CASE WHEN d THEN {dashes} ELSE rtrim({line}) END AS line FROM (SELECT *, {widths} FROM ({every})), (VALUES (FALSE), (TRUE)) AS v(d) WHERE NOT d OR o = 0"


def _report_sql() -> str:
    """The report of the orders comparison without samples; sections are numbered, and lines within them."""
    counts, stats = _counted(ORDERS_J, EVERY_ORDER), orders_stats()
    shapes = "SELECT 1 AS o, 'df1' AS c0, '6' AS c1, format('{:,}', common + left_only) AS c2 FROM counts UNION ALL SELECT 2, 'df2', '6', format('{:,}', common + right_only) FROM counts"
    number = lambda c: f"printf('%.4f', {c})"
    unequal = f"SELECT row_number() OVER (ORDER BY \"column\") AS o, \"column\" AS c0, dtype1 AS c1, dtype2 AS c2, format('{{:,}}', unequal_cnt) AS c3, {number('max_diff')} AS c4, format('{{:,}}', null_diff) AS c5, {number('rel_tol')} AS c6, {number('abs_tol')} AS c7 FROM stats WHERE NOT all_match"
    told = lambda label, value, source="counts": f"SELECT '{label}: ' || format('{{:,}}', CAST({value} AS BIGINT)) FROM {source}"
    fixed = lambda *lines: " UNION ALL ".join(f"SELECT {n} AS o, ({x if x.startswith('SELECT') else f'SELECT {chr(39)}{x}{chr(39)}'}) AS line" for n, x in enumerate(lines))
    sections = [
        ("Comparison", None),
        ("DataFrame Summary", text_table(["DataFrame", "Columns", "Rows"], shapes, "lrr")),
        ("Column Summary", fixed("Number of columns in common: 6", "Number of columns in df1 but not in df2: 0", "Number of columns in df2 but not in df1: 0")),
        (
            "Row Summary",
            fixed(
                "Matched on: o_orderkey", "Any duplicates on match values: No", "Default Absolute Tolerance: 0", "Default Relative Tolerance: 0",
                told("Number of rows in common", "common"), told("Number of rows in df1 but not in df2", "left_only"), told("Number of rows in df2 but not in df1", "right_only"),
                "", told("Number of rows with some compared columns unequal", "unequal_rows"), told("Number of rows with all compared columns equal", "equal_rows"),
            ),
        ),
        (
            "Column Comparison",
            fixed(
                told("Number of columns compared with some values unequal", "count(*) FILTER (WHERE unequal_cnt > 0)", "stats"),
                told("Number of columns compared with all values equal", "count(*) FILTER (WHERE unequal_cnt = 0)", "stats"),
                told("Total number of values which compare unequal", "sum(unequal_cnt)", "stats"),
            ),
        ),
        ("Columns with Unequal Values or Types", text_table(["Column", "df1 dtype", "df2 dtype", "# Unequal", "Max Diff", "# Null Diff", "Rel Tol", "Abs Tol"], unequal, "lllrrrrr")),
    ]
    parts = []
    for n, (title, body) in enumerate(sections):
        parts.append(f"SELECT {n} AS s, o, line FROM (VALUES (-3, '{title}'), (-2, '{'-' * len(title)}'), (-1, '')) AS t(o, line)")
        if body:
            parts.append(f"SELECT {n}, o, line FROM ({body}) UNION ALL SELECT {n}, 1000, ''")
    return f"WITH counts AS ({counts}), stats AS ({stats}) SELECT CAST(row_number() OVER (ORDER BY s, o) - 1 AS INT) AS n, line FROM ({' UNION ALL '.join(parts)})"


REPORT_SQL = _report_sql()


def _samples_sql() -> str:
    found = []
    for c in ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"):
        match = near(c) if c == "o_totalprice" else equal(c)
        text = lambda x: f"coalesce(CAST({x} AS VARCHAR), 'None')"
        found.append(f"SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY l.o_orderkey) - 1 AS INT) AS n, CAST(l.o_orderkey AS VARCHAR) AS o_orderkey, {text(f'l.{c}')} AS left_value, {text(f'r.{c}')} AS right_value FROM j WHERE in_l AND in_r AND NOT ({match}) QUALIFY n < 4")
    return f"{ORDERS_J} {' UNION ALL '.join(found)}"


SAMPLES_SQL = _samples_sql()
JSON_SQL = f"""WITH counts AS ({_counted(ORDERS_J, EVERY_ORDER)}), stats AS ({orders_stats()}) SELECT item, n FROM (
    SELECT 'row_summary.common_rows' AS item, common AS n FROM counts UNION ALL SELECT 'row_summary.df1_unique', left_only FROM counts UNION ALL SELECT 'row_summary.df2_unique', right_only FROM counts
    UNION ALL SELECT 'row_summary.unequal_rows', unequal_rows FROM counts UNION ALL SELECT 'row_summary.equal_rows', equal_rows FROM counts
    UNION ALL SELECT 'column_summary.common_columns', 6 UNION ALL SELECT 'column_summary.df1_unique', 0 UNION ALL SELECT 'column_summary.df2_unique', 0
    UNION ALL SELECT 'column_comparison.unequal_columns', count(*) FILTER (WHERE unequal_cnt > 0) FROM stats UNION ALL SELECT 'column_comparison.equal_columns', count(*) FILTER (WHERE unequal_cnt = 0) FROM stats
    UNION ALL SELECT 'column_comparison.unequal_values', CAST(sum(unequal_cnt) AS BIGINT) FROM stats
    UNION ALL SELECT 'df1_shape.0', common + left_only FROM counts UNION ALL SELECT 'df1_shape.1', 6 UNION ALL SELECT 'df2_shape.0', common + right_only FROM counts UNION ALL SELECT 'df2_shape.1', 6)"""

#: Name: (query, SQL or None).
REGISTRY: dict[str, tuple[Query, str | None]] = {
    "column_stats_basic": (lambda s, d: orders(s, d).column_stats_frame(), orders_stats()),
    "row_summary": (row_summary, _counted(ORDERS_J, EVERY_ORDER)),
    "left_only_rows": (lambda s, d: orders(s, d).left_only(), _anti(ORDERS_L, ORDERS_R)),
    "right_only_rows": (lambda s, d: orders(s, d).right_only(), _anti(ORDERS_R, ORDERS_L)),
    "matched_rows": (
        matched_rows,
        _both_sql(ORDERS_L, ORDERS_R, ["o_orderkey"], "l.o_orderkey AS o_orderkey_a, r.o_orderkey AS o_orderkey_b, " + PAIRS + ", " + ", ".join(f"{near(c) if c == 'o_totalprice' else equal(c)} AS {c}_match" for c in ORDER_COLUMNS)),
    ),
    "all_mismatch": (lambda s, d: orders(s, d, left_name="a", right_name="b").mismatches(), _both_sql(ORDERS_L, ORDERS_R, ["o_orderkey"], "l.o_orderkey, " + PAIRS, f"AND NOT ({EVERY_ORDER})")),
    "all_mismatch_drop_equal": (
        lambda s, d: orders(s, d, left_name="a", right_name="b").mismatches(drop_equal_columns=True),
        _both_sql(ORDERS_L, ORDERS_R, ["o_orderkey"], "l.o_orderkey, " + PAIRS.replace("l.o_custkey AS o_custkey_a, r.o_custkey AS o_custkey_b, ", ""), f"AND NOT ({EVERY_ORDER})"),
    ),
    "cell_diff": (
        lambda s, d: orders(s, d).cell_diff().where("`column` IN ('o_orderstatus', 'o_orderpriority')"),
        ORDERS_J + " " + " UNION ALL ".join(f"SELECT l.o_orderkey, '{c}' AS \"column\", l.{c} AS left_value, r.{c} AS right_value FROM j WHERE in_l AND in_r AND NOT ({equal(c)})" for c in ("o_orderstatus", "o_orderpriority")),
    ),
    "sample_mismatch_top5": (
        lambda s, d: orders(s, d, left_name="a", right_name="b").sample("o_totalprice", 5),
        _both_sql(ORDERS_L, ORDERS_R, ["o_orderkey"], "l.o_orderkey, l.o_totalprice AS o_totalprice_a, r.o_totalprice AS o_totalprice_b", f"AND NOT {near('o_totalprice')} ORDER BY 1 LIMIT 5"),
    ),
    "sample_key_column": (lambda s, d: orders(s, d).sample("o_orderkey", 7), f"SELECT o_orderkey FROM ({_anti(ORDERS_L, ORDERS_R, 'o_orderkey')} UNION ALL {_anti(ORDERS_R, ORDERS_L, 'o_orderkey')}) ORDER BY 1 LIMIT 7"),
    "columns_with_mismatches": (
        lambda s, d: s.createDataFrame([(c,) for c in orders(s, d).columns_with_mismatches()], "name string"),
        f"SELECT \"column\" AS name FROM ({orders_stats()}) WHERE unequal_cnt > 0",
    ),
    "key_only_compare": (lambda s, d: key_only(s, d).column_stats_frame(), stats_sql(KEY_J, [("o_orderkey", "bigint"), ("o_custkey", "bigint")], [], only_keys=True)),
    "key_only_mismatch": (lambda s, d: key_only(s, d).mismatches(), f"{_anti(KEYS_13, KEYS_11)} UNION ALL {_anti(KEYS_11, KEYS_13)}"),
    "abs_tolerance": (lambda s, d: orders(s, d, abs_tol=0.6).column_stats_frame(), orders_stats(price=near("o_totalprice", 0.6), tol=(0, 0.6))),
    "rel_tolerance": (
        lambda s, d: pairs(s, d, "SELECT * FROM {orders}", SCALE_R, "o_orderkey", rel_tol={"o_totalprice": 0.000003}).column_stats_frame(),
        stats_sql(SCALED_J, [("o_orderkey", "bigint")], [(*x[:5], 0.000003 if x[0] == "o_totalprice" else 0, 0) for x in order_columns(price=near("o_totalprice", 0, 0.000003))]),
    ),
    "per_column_tolerance": (
        lambda s, d: orders(s, d, abs_tol={"O_TOTALPRICE": 0.4, "default": 0.25}).column_stats_frame().where("`column` <> 'o_orderkey'"),
        stats_sql(ORDERS_J, [], [(*x[:6], 0.4 if x[0] == "o_totalprice" else 0.25) for x in order_columns(price=near("o_totalprice", 0.4))]),
    ),
    "nan_null_numeric": (lambda s, d: numbers(s, 0.0, 0.0), numbers_sql(0.0, 0.0)),
    "numeric_tolerance_truth": (lambda s, d: numbers(s, 0.3, 0.0002), numbers_sql(0.3, 0.0002)),
    "int_double_cross_type": (
        lambda s, d: (lambda t: compare(t.selectExpr("id", "a AS v"), t.selectExpr("id", "n AS v"), "id", left_name="a", right_name="b").matched().select("id_a", "v_match"))(s.sql(MIXED)),
        f"SELECT id AS id_a, a IS NOT DISTINCT FROM CAST(n AS DOUBLE) AS v_match FROM ({MIXED})",
    ),
    "decimal_exact": (
        lambda s, d: (lambda t: compare(t.selectExpr("id", "d AS v"), t.selectExpr("id", "CAST(b AS DECIMAL(12, 2)) AS v"), "id", left_name="a", right_name="b", abs_tol=0.000004).matched().select("id_a", "v_match"))(s.sql(MIXED)),
        f"SELECT id AS id_a, CAST(a AS DECIMAL(20, 6)) IS NOT DISTINCT FROM CAST(b AS DECIMAL(12, 2)) OR coalesce(abs(CAST(d AS DOUBLE) - b) <= 0.000004, FALSE) AS v_match FROM ({MIXED})",
    ),
    "string_ignore_case": (lambda s, d: orders(s, d, ignore_case=True).column_stats_frame(), orders_stats(priority=ALIKE)),
    "string_ignore_spaces": (lambda s, d: orders(s, d, ignore_spaces=True).column_stats_frame(), orders_stats(priority=TRIMMED)),
    "string_both": (lambda s, d: orders(s, d, ignore_spaces=True, ignore_case=True).column_stats_frame(), orders_stats(priority=BOTH)),
    "trimmed_keys": (
        lambda s, d: counts_frame(s, pairs(s, d, NAMES_L, NAMES_R, "k", ignore_spaces=True)),
        _counted(TRIM_J, f"{equal('c_nationkey')} AND {near('c_acctbal')}"),
    ),
    "untrimmed_keys": (
        lambda s, d: counts_frame(s, pairs(s, d, NAMES_L, NAMES_R, "k")),
        _counted(joined(NAMES_L, NAMES_R, ["k"]), f"{equal('c_nationkey')} AND {near('c_acctbal')}"),
    ),
    "date_vs_string": (
        lambda s, d: pairs(s, d, DATES_L, DATES_R, "o_orderkey").matched().selectExpr("o_orderkey_a AS o_orderkey", "d_match", "t_match"),
        _both_sql(DATES_L, DATES_R, ["o_orderkey"], "l.o_orderkey, l.d IS NOT DISTINCT FROM TRY_CAST(r.d AS DATE) AS d_match, l.t IS NOT DISTINCT FROM CAST(r.t AS TIMESTAMP) AS t_match"),
    ),
    "timestamp_equal": (lambda s, d: orders(s, d).column_stats_frame().where("`column` = 'o_orderdate'"), f"SELECT * FROM ({orders_stats()}) WHERE \"column\" = 'o_orderdate'"),
    "bool_vs_int": (
        lambda s, d: pairs(s, d, BOOLS_L, BOOLS_R, "doc_id").matched().selectExpr("doc_id_a AS doc_id", "x_match", "y_match", "z_match"),
        _both_sql(BOOLS_L, BOOLS_R, ["doc_id"], "l.doc_id, (r.x AND l.x = 1) OR (NOT r.x AND l.x = 0) AS x_match, (l.y AND r.y = 1) OR (NOT l.y AND r.y = 0) AS y_match, l.z IS NOT DISTINCT FROM r.z AS z_match"),
    ),
    "array_equal_embeddings": (
        lambda s, d: pairs(s, d, VECTORS_L, _reversed(VECTORS_R, "reverse"), "vec_id").matched().selectExpr("vec_id_a AS vec_id", "embedding_match"),
        _both_sql(VECTORS_L, _reversed(VECTORS_R, "list_reverse"), ["vec_id"], "l.vec_id, l.embedding IS NOT DISTINCT FROM r.embedding AS embedding_match"),
    ),
    "unsupported_types_false": (
        lambda s, d: pairs(s, d, TYPES_L, TYPES_R, "o_orderkey").column_stats_frame().where("`column` = 's'"),
        stats_sql(joined(TYPES_L, TYPES_R, ["o_orderkey"]), [], [("s", "string", "double", "FALSE", distance("s"), 0, 0)]),
    ),
    "type_mismatch_all_equal": (
        lambda s, d: pairs(s, d, TYPES_L, TYPES_R, "o_orderkey").column_stats_frame().where("`column` = 'n'").select("column", "match_cnt", "unequal_cnt", "dtype1", "dtype2", "all_match"),
        f"SELECT 'n' AS \"column\", count(*) AS match_cnt, CAST(0 AS BIGINT) AS unequal_cnt, 'bigint' AS dtype1, 'int' AS dtype2, FALSE AS all_match FROM ({duck(TYPES_L)})",
    ),
    "duplicate_keys_lineitem": (
        lambda s, d: lines(s, d).column_stats_frame().where("`column` = 'l_quantity'"),
        f"SELECT * FROM ({stats_sql(LINE_J, [('l_orderkey', 'bigint')], [('l_quantity', 'double', 'double', near('l_quantity'), distance('l_quantity'), 0, 0)])}) WHERE \"column\" = 'l_quantity'",
    ),
    "duplicate_multiset_counts": (
        lambda s, d: counts_frame(s, lines(s, d)).select("common", "left_only", "right_only"),
        f"""SELECT (SELECT count(*) FROM ({duck(LINES_R)})) - right_only AS common, left_only, right_only FROM (SELECT
            (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM ({duck(LINES_L)}) EXCEPT ALL SELECT l_orderkey, l_linenumber FROM ({duck(LINES_R)}))) AS left_only,
            (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM ({duck(LINES_R)}) EXCEPT ALL SELECT l_orderkey, l_linenumber FROM ({duck(LINES_L)}))) AS right_only)""",
    ),
    "duplicate_left_only_rows": (
        lambda s, d: lines(s, d).left_only().select(*LINE_KEYS),
        f"SELECT l_orderkey, l_linenumber FROM ({duck(LINES_L)}) EXCEPT ALL SELECT l_orderkey, l_linenumber FROM ({duck(LINES_R)})",
    ),
    "null_keys_match": (
        lambda s, d: counts_frame(s, pairs(s, d, NULL_KEYS_L, NULL_KEYS_R, "k", order_by=["seq"])),
        _counted(joined(NULL_KEYS_L, NULL_KEYS_R, ["k"], ["seq"]), f"{equal('seq')} AND {near('c_acctbal')}"),
    ),
    "null_keys_duplicates": (
        lambda s, d: pairs(s, d, NULL_KEYS_L, NULL_KEYS_R, "k", order_by=["seq"]).mismatches(),
        f"{joined(NULL_KEYS_L, NULL_KEYS_R, ['k'], ['seq'])} SELECT l.k, l.seq AS seq_a, r.seq AS seq_b, l.c_acctbal AS c_acctbal_a, r.c_acctbal AS c_acctbal_b FROM j WHERE in_l AND in_r AND NOT ({equal('seq')} AND {near('c_acctbal')})",
    ),
    "multi_column_key": (
        lambda s, d: counts_frame(s, pairs(s, d, ORDERS_L, ORDERS_R, ["o_orderkey", "o_custkey"])),
        _counted(joined(ORDERS_L, ORDERS_R, ["o_orderkey", "o_custkey"]), " AND ".join(f"({near(c) if c == 'o_totalprice' else equal(c)})" for c in ORDER_COLUMNS if c != "o_custkey")),
    ),
    "extra_columns_summary": (
        extra_columns,
        "SELECT * FROM (VALUES ('common', CAST(0 AS INT), 'o_orderkey'), ('common', 1, 'o_custkey'), ('common', 2, 'o_orderstatus'), ('left', 0, 'price'), ('left', 1, 'day'), ('right', 0, 'o_orderpriority')) AS t(side, place, name)",
    ),
    "max_diff_mixed": (
        lambda s, d: (lambda t: compare(t.selectExpr("id", "a AS v"), t.selectExpr("id", "b AS v"), "id").column_stats_frame().where("`column` = 'v'").select("max_diff", "null_diff", "unequal_cnt"))(s.sql(WORDS)),
        f"SELECT max(abs(TRY_CAST(a AS DOUBLE) - TRY_CAST(b AS DOUBLE))) AS max_diff, count(*) FILTER (WHERE (a IS NULL) <> (b IS NULL)) AS null_diff, count(*) FILTER (WHERE a IS DISTINCT FROM b) AS unequal_cnt FROM ({WORDS})",
    ),
    "null_diff": (lambda s, d: orders(s, d).column_stats_frame().select("column", "null_diff"), f"SELECT \"column\", null_diff FROM ({orders_stats()})"),
    "verdicts": (
        verdicts,
        "SELECT * FROM (VALUES ('same', TRUE, TRUE, TRUE, TRUE, TRUE, TRUE), ('fewer', FALSE, FALSE, TRUE, TRUE, FALSE, TRUE), ('changed', FALSE, FALSE, FALSE, TRUE, TRUE, FALSE), ('narrow', FALSE, TRUE, TRUE, FALSE, TRUE, TRUE), ('empty', FALSE, FALSE, FALSE, TRUE, TRUE, FALSE)) AS t(scenario, matches, matches_ignoring_columns, is_subset, columns_match, rows_overlap, common_match)",
    ),
    "threshold_verdict": (threshold_verdict, "SELECT FALSE AS at_unequal, TRUE AS ignoring_unique, FALSE AS one_less, TRUE AS all_counted"),
    "masked_rows": (
        masked,
        _both_sql(ORDERS_L, ORDERS_R, ["o_orderkey"], "l.o_orderkey, " + ", ".join(f"'*******' AS {c}_a, '*******' AS {c}_b" if c in ("o_custkey", "o_totalprice") else f"l.{c} AS {c}_a, r.{c} AS {c}_b" for c in ORDER_COLUMNS), f"AND NOT ({EVERY_ORDER})"),
    ),
    "custom_rule_length": (
        lambda s, d: pairs(s, d, LENGTHS_L, LENGTHS_R, "p_partkey", rules=[same_length]).matched().select("p_partkey_a", "p_name_match", "p_brand_match"),
        _both_sql(LENGTHS_L, LENGTHS_R, ["p_partkey"], "l.p_partkey AS p_partkey_a, length(l.p_name) IS NOT DISTINCT FROM length(r.p_name) AS p_name_match, length(l.p_brand) IS NOT DISTINCT FROM length(r.p_brand) AS p_brand_match"),
    ),
    "shapes": (shapes, f"SELECT 'left' AS side, count(*) AS n_rows, CAST(6 AS INT) AS n_columns FROM ({duck(ORDERS_L)}) UNION ALL SELECT 'right', count(*), 6 FROM ({duck(ORDERS_R)})"),
    "report_row_summary": (
        report_row_summary,
        f"SELECT item, n FROM ({_counted(ORDERS_J, EVERY_ORDER)}) UNPIVOT (n FOR item IN (common AS 'common_rows', left_only AS 'df1_unique', right_only AS 'df2_unique', unequal_rows AS 'unequal_rows', equal_rows AS 'equal_rows'))",
    ),
    "report_lines": (report_lines, REPORT_SQL),
    "report_samples": (report_samples, SAMPLES_SQL),
    "match_rates": (match_rates, f'SELECT "column", match_cnt / (match_cnt + unequal_cnt) AS match_rate FROM ({orders_stats()})'),
    "column_totals": (column_totals, f"SELECT count(*) FILTER (WHERE unequal_cnt > 0) AS unequal_columns, count(*) FILTER (WHERE unequal_cnt = 0) AS equal_columns, CAST(sum(unequal_cnt) AS BIGINT) AS unequal_values FROM ({orders_stats()})"),
    "sorted_mismatch_stats": (sorted_stats, f'SELECT CAST(row_number() OVER (ORDER BY "column") - 1 AS INT) AS n, "column", unequal_cnt, FALSE AS has_samples FROM ({orders_stats()}) WHERE NOT all_match'),
    "display_sample": (
        lambda s, d: orders(s, d).sample("o_orderstatus", 6, for_display=True),
        _both_sql(ORDERS_L, ORDERS_R, ["o_orderkey"], 'l.o_orderkey, l.o_orderstatus AS "o_orderstatus (df1)", r.o_orderstatus AS "o_orderstatus (df2)"', f"AND NOT ({equal('o_orderstatus')}) ORDER BY 1 LIMIT 6"),
    ),
    "first_rows_and_columns": (lambda s, d: orders(s, d).alone("right", 5, 3), f"{_anti(ORDERS_R, ORDERS_L, 'o_orderkey, o_custkey, o_orderstatus')} ORDER BY 1 LIMIT 5"),
    "json_report": (json_summary, JSON_SQL),
    "html_report": (html_page, "SELECT '<html>' AS head, '</html>' AS tail, TRUE AS name, TRUE AS cell, FALSE AS raw"),
    "text_tables": (
        plain_tables,
        "SELECT * FROM (VALUES (CAST(0 AS INT), 'name          n'), (1, '--------  -----'), (2, 'a         1,000'), (3, 'long one      7'), (4, 'a'), (5, '-'), (6, 'yes')) AS t(n, line)",
    ),
    "report_long_names": (long_names, "SELECT * FROM (VALUES ('a_column_of_twenty__x'[:17] || '...'), ('another_column_of...')) AS t(name)"),
    "lower_case_names": (renamed, "SELECT * FROM (VALUES ('folded', TRUE, 'id,name', ''), ('kept', FALSE, 'ID', 'Name')) AS t(names, matches, common, left_only)"),
    "revealed_rows": (revealed, _both_sql(ORDERS_L, ORDERS_R, ["o_orderkey"], "l.o_orderkey, " + PAIRS, f"AND NOT ({EVERY_ORDER})")),
    "refusals": (
        refusals,
        "SELECT * FROM (VALUES ('unknown sample', 'ValueError'), ('hidden twice', 'ValueError'), ('hidden named twice', 'ValueError'), ('hidden number', 'TypeError'), ('missing key', 'ValueError'), ('same names', 'ValueError'), ('negative tolerance', 'ValueError'), ('tolerance of text', 'TypeError'), ('no table', 'TypeError')) AS t(call, error) UNION ALL SELECT 'unknown template', "
        + f"'{'FileNotFoundError' if importlib.util.find_spec('jinja2') else 'RuntimeError'}'",
    ),
    "custom_rule_context": (
        lambda s, d: orders(s, d, left_name="a", right_name="b", abs_tol={"o_totalprice": 0.46}, rules=[tolerant_rule]).matched().select("o_orderkey_a", "o_totalprice_match"),
        _both_sql(ORDERS_L, ORDERS_R, ["o_orderkey"], "l.o_orderkey AS o_orderkey_a, abs(l.o_totalprice - r.o_totalprice) <= 0.46e0 * 1.1e0 AS o_totalprice_match"),
    ),
    "json_document": (json_document, "SELECT TRUE AS matches, count(*) AS common FROM nation"),
    "catalog_tables": (catalog_tables, "SELECT CAST(p AS INT) AS left_parts, CAST(q AS INT) AS right_parts, TRUE AS named, TRUE AS matches, (SELECT count(*) FROM customer) AS common FROM (VALUES (1, 2), (2, 3)) AS t(p, q)"),
    "cached_rows": (cached, _counted(ORDERS_J, EVERY_ORDER)),
    "cli_flags": (
        cli_flags,
        "SELECT * FROM (VALUES ('plain', CAST(1 AS INT)), ('loose', 1), ('loose, one row', 0), ('loose, unique ignored', 0), ('tight tolerance', 1), ('relative tolerance', 0), ('case kept', 2), ('wrong format', 2), ('names', 0), ('equal names', 2), ('by place', 0), ('place without order', 2), ('key and place', 2), ('no key', 2), ('mixed tolerances', 2), ('unwritable', 2)) AS t(call, exit_code)",
    ),
    "cli_output": (cli_output, "SELECT k AS format, CAST(0 AS INT) AS exit_code, (SELECT count(*) FROM nation) AS common, TRUE AS named FROM (VALUES ('text'), ('json'), ('html')) AS t(k)"),
    "file_round_trip": (file_round_trip, "SELECT f AS format, TRUE AS matches, (SELECT count(*) FROM customer) AS common FROM (VALUES ('csv'), ('parquet'), ('jsonl'), ('pq')) AS t(f)"),
    "cli_exit_codes": (cli_exit_codes, "SELECT * FROM (VALUES ('same', CAST(0 AS INT)), ('bad key', 2), ('missing file', 2)) AS t(call, exit_code)"),
    "position_key": (
        positions,
        _counted(
            joined(
                "SELECT c_acctbal, c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS position FROM {customer}",
                "SELECT c_acctbal, c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS position FROM {customer} WHERE c_custkey % 40 <> 7",
                ["position"],
            ),
            f"{equal('c_custkey')} AND {near('c_acctbal')}",
        ),
    ),
}

QUERIES: dict[str, Query] = {name: query for name, (query, _) in REGISTRY.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in REGISTRY.items() if sql}
