import logging

import pytest
from pyspark.sql import functions as F
from tablewright import compare
from tablewright.operators import align, with_position
from tablewright.streaming import reconcile


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture()
def accounts(spark):
    schema = "acct_id bigint, dollar_amt double, name string, float_fld double, date_fld string"
    left = frame(spark, [(1, 123.45, "George", 1.0, "a"), (2, 0.45, "Michael", 1.0, "b"), (3, 13.45, "Bob", None, "c"), (4, 5.0, "Gob", 4.0, "d"), (5, 7.0, "Lucille", 5.0, "e"), (6, 8.0, "Buster", 6.0, "f")], schema)
    right = frame(spark, [(1, 123.4, "George Bluth", 1.0, "a"), (2, 0.45, "Michael", 1.0, "b"), (3, 13.45, "Bob", 3.0, "c"), (4, 5.0, "Gob", 4.0, "x"), (5, 7.0, "Lucille", 5.0, "e"), (7, 9.0, "Tobias", 6.0, "g")], schema)
    return left, right


def test_account_tables(accounts):
    c = compare(*accounts, "acct_id")
    assert tuple(vars(c.row_counts()).values()) == (5, 1, 1, 2)
    assert not c.matches() and not c.is_subset() and c.all_columns_match() and not c.all_rows_overlap()
    assert c.columns_with_mismatches() == ["dollar_amt", "name", "float_fld", "date_fld"]
    assert c.mismatches().count() == 3 and len(c.mismatches().columns) == 9
    assert c.sample("name", 2).columns == ["acct_id", "name_df1", "name_df2"] and c.sample("name", for_display=True).columns == ["acct_id", "name (df1)", "name (df2)"]
    assert c.left_only().columns == accounts[0].columns and [r.acct_id for r in c.right_only().collect()] == [7]
    assert {(r.acct_id, r.column) for r in c.cell_diff().collect()} == {(1, "dollar_amt"), (1, "name"), (3, "float_fld"), (4, "date_fld")}
    assert c.shapes() == ((6, 5), (6, 5))


def test_one_job_for_all_statistics(spark, accounts):
    c = compare(*accounts, "acct_id", unique_keys=True)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("stats", "stats")
    c.matches(), c.is_subset(), c.column_stats(), c.shapes(), c.within(3)
    first = set(tracker.getJobIdsForGroup("stats"))
    c.matches(), c.columns_with_mismatches(), c.row_counts()
    assert set(tracker.getJobIdsForGroup("stats")) == first
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_plan_is_one_sort_merge_join_without_python(accounts):
    plan = compare(*accounts, "acct_id")._aligned.full()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FullOuter") == 1 and "SortMergeJoin" in plan and "Python" not in plan


def test_column_algebra_keeps_order(spark):
    left = frame(spark, [(1,) * 7], "join int, f int, g int, b int, h int, a int, c int")
    right = frame(spark, [(1,) * 7], "join int, e int, h int, b int, a int, g int, d int")
    c = compare(left, right, "JOIN")
    assert (c.left_only_columns(), c.right_only_columns(), c.common_columns()) == (["f", "c"], ["e", "d"], ["join", "g", "b", "h", "a"])
    assert c.matches(ignore_extra_columns=True) and not c.matches()


@pytest.mark.parametrize(("left", "right", "want"), [([(1, 2), (1, 2)], [(1, 2), (1, 2)], (2, 0, 0)), ([(1, 2), (1, 2)], [(3, 4), (3, 4)], (0, 2, 2)), ([(1, 2)] * 3, [(1, 2)] * 2, (2, 1, 0))])
def test_duplicates_are_a_multiset(spark, left, right, want):
    c = compare(frame(spark, left, "a bigint, b bigint"), frame(spark, right, "a bigint, b bigint"), ["a", "b"])
    r = c.row_counts()
    assert (r.common, r.left_only, r.right_only) == want and c.has_duplicates
    assert c.left_only().count() == want[1] and c.right_only().count() == want[2]


def test_duplicates_pair_in_order(spark):
    left = frame(spark, [(1, n, n) for n in range(12)], "k int, seq int, v int")
    right = frame(spark, [(1, n, n) for n in range(11, -1, -1)], "k int, seq int, v int")
    assert compare(left, right, "k", order_by=["SEQ"]).matches()
    assert not compare(left.coalesce(1), right.coalesce(1), "k").matches()


@pytest.mark.parametrize("order", [["seq"], []])
def test_hot_keys_are_numbered_apart(spark, order):
    schema = "k string, j int, seq int, v int"
    rows = [("hot", None, n, n) for n in range(300)] + [(None, 1, n, n) for n in range(200)] + [(f"k{n % 40}", n % 3, n, n) for n in range(200)]
    left, right = frame(spark, rows, schema).repartition(7, "v"), frame(spark, [r for r in rows if r[2] != 5], schema).repartition(5, "v")
    c = compare(left, right, ["k", "j"], order_by=order)
    plain, apart = align(c.left, c.right, c.spec, c._key_facts), align(c.left, c.right, c.spec, c._key_facts, hot_rows=50)
    assert c._key_facts.most == 300
    numbered = lambda a: sorted((str(r[:2]), r.ln) for r in a.left.select("lk0", "lk1", "ln").collect())
    assert numbered(plain) == numbered(apart)
    assert plain.left_only().count() == apart.left_only().count() == 3 and apart.both().count() == 697
    if order:
        assert sorted(plain.left.select("l0", "ln").collect()) == sorted(apart.left.select("l0", "ln").collect())


def test_null_and_trimmed_keys(spark):
    left = frame(spark, [(None, 1), (None, 2), (" hi ", 3), ("hi", 4)], "a string, b int")
    right = frame(spark, [(None, 1), (None, 2), ("hi", 3), ("hi", 4)], "a string, b int")
    c = compare(left, right, "a", order_by=["b"])
    assert (c.row_counts().common, c.row_counts().left_only, c.row_counts().right_only) == (3, 1, 1)
    assert compare(left, right, "a", ignore_spaces=True, order_by=["b"]).matches()


def test_keys_of_different_number_types(spark):
    left = frame(spark, [(1, 2), (3, 4)], "a int, b bigint").withColumn("a", F.col("a").cast("decimal(10,2)"))
    assert compare(left, frame(spark, [(1, 2), (3, 4)], "a bigint, b bigint"), "a").matches()


def test_only_keys(spark):
    left = frame(spark, [(1, 1), (2, 2), (3, 3)], "a bigint, b bigint")
    right = frame(spark, [(1, 1), (4, 4)], "a bigint, b bigint")
    c = compare(left, right, ["a", "b"])
    assert c.only_keys() and c.mismatches().count() == 3 and c.sample("a", 2).count() == 2
    assert [(s.match_cnt, s.unequal_cnt) for s in c.column_stats()] == [(1, 3), (1, 3)] and c.columns_with_mismatches() == []
    one_sided = compare(left.withColumn("c", F.lit(1)), right.withColumn("d", F.lit(1)), ["a", "b"])
    assert not one_sided.only_keys() and one_sided.mismatches().columns == ["a", "b"] and one_sided.mismatches(True).count() == 3


def test_empty_tables_never_match(spark):
    empty = frame(spark, [], "id int, v int")
    c = compare(empty, empty, "id")
    assert not c.matches() and not c.is_subset() and c.all_rows_overlap() and c.within(0)
    assert [s.max_diff for s in c.column_stats()] == [0.0, 0.0] and c.mismatches().count() == 0 and c.report()
    full = frame(spark, [(1, 1)], "id int, v int")
    assert compare(full, empty, "id").row_counts().left_only == 1 and not compare(empty, full, "id").is_subset()


def test_subset(spark):
    left = frame(spark, [(1, 2, 3), (4, 5, 6)], "a int, b int, c int")
    assert compare(left, left.drop("b").limit(1), "a").is_subset()
    assert not compare(left, left.withColumn("c", F.lit(0)), "a").is_subset()


def test_type_difference_shows_but_matches(spark):
    left, right = frame(spark, [(1, 1)], "id int, v int"), frame(spark, [(1, 1)], "id int, v bigint")
    c = compare(left, right, "id")
    (stat,) = [s for s in c.column_stats() if s.column == "v"]
    assert c.matches() and not stat.all_match and stat.unequal_cnt == 0 and "int" in c.report()
    assert not c.report_data().mismatch_stats.has_samples


def test_odd_names(spark):
    left = frame(spark, [(1, 2, 3, 4, 5)], "`a.b` int, `x y` int, `l0` int, `in_left` int, `予測` int")
    right = frame(spark, [(1, 2, 9, 4, 5)], "`a.b` int, `x y` int, `l0` int, `in_left` int, `予測` int")
    c = compare(left, right, ["a.b", "x y"])
    assert c.columns_with_mismatches() == ["l0"] and c.mismatches().count() == 1 and c.left_only().count() == 0 and c.sample("l0").count() == 1
    assert c.matched().columns[:2] == ["a.b_df1", "a.b_df2"] and c.cell_diff().count() == 1
    numbered = frame(spark, [(1, 2)], "`1` int, `2` int")
    assert compare(numbered, numbered, 1).matches()


def test_name_case(spark):
    left, right = frame(spark, [(1, 2)], "a int, b int"), frame(spark, [(1, 2)], "A int, B int")
    assert compare(left, right, "A").matches()
    with pytest.raises(ValueError, match="lacks key"):
        compare(left, right, "a", lower_names=False)
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        twice = frame(spark, [(1, 2)], "a int, A int")
        with pytest.raises(ValueError, match="differ in case"):
            compare(twice, twice, "a", lower_names=False)
        with pytest.raises(ValueError, match="unique"):
            compare(twice, twice, "a")
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_refusals(spark):
    df = frame(spark, [(1, "x")], "id int, s string")
    for error, call in (
        (TypeError, lambda: compare([1], df, "id", spark=spark)), (ValueError, lambda: compare(df, df, [])), (ValueError, lambda: compare(df, df, None)), (ValueError, lambda: compare(df, df, "nope")), (ValueError, lambda: compare(df, df, ["id", "ID"])),
        (ValueError, lambda: compare(df, df.selectExpr("s AS id", "id AS s"), "id")), (ValueError, lambda: compare(df, df, "id", abs_tol=-1)), (ValueError, lambda: compare(df, df, "id", rel_tol={"id": -0.1})),
        (ValueError, lambda: compare(df, df, "id", rel_tol={"id": "x"})), (TypeError, lambda: compare(df, df, "id", abs_tol="1")), (ValueError, lambda: compare(df, df, "id", left_name="n", right_name="n")), (ValueError, lambda: compare(df, df, "id").sample("zzz")),
        (ValueError, lambda: compare(df, df, "id", whitespace="none")), (ValueError, lambda: compare(spark.readStream.format("rate").load(), df, "id")),
    ):
        with pytest.raises(error):
            call()


def test_tolerance_names_fold_case(spark):
    left, right = frame(spark, [(1, 1.0, 1.0)], "id int, A double, b double"), frame(spark, [(1, 1.1, 1.1)], "id int, a double, B double")
    assert compare(left, right, "id", abs_tol={"a": 0.2}).columns_with_mismatches() == ["b"]
    assert compare(left, right, "id", abs_tol={"A": 0.2, "default": 0.2}).matches()


def test_masking(accounts, caplog):
    c = compare(*accounts, "acct_id")
    c.hide(["NAME", "acct_id"])
    for df in (c.left_only(), c.right_only(), c.mismatches(), c.matched(), c.sample("name"), c.sample("name", for_display=True), c.sample("acct_id"), c.cell_diff().where("column = 'name'").drop("column")):
        hidden = [x for x in df.columns if x.startswith(("name", "acct_id")) and not x.endswith("match")]
        assert hidden and all(v == "*******" for r in df.select(*[f"`{x}`" for x in hidden]).collect() for v in r)
    assert "George" not in c.report() and accounts[0].first().name == "George"
    with pytest.raises(ValueError):
        c.hide(["name"])
    c.reveal()
    c.reveal()
    assert c.left_only().first().name == "Buster"
    with pytest.raises(ValueError):
        c.hide(["name", "Name"])
    with pytest.raises(TypeError):
        c.hide([1])
    with caplog.at_level(logging.WARNING):
        c.hide(["nowhere"])
    assert "nowhere" in caplog.text


def test_cache_is_given_back(spark, accounts):
    with compare(*accounts, "acct_id", cache=True) as c:
        c.mismatches().count()
        assert c._kept.is_cached
        kept = c._kept
    assert not kept.storageLevel.useMemory


def test_catalog_tables(spark, accounts):
    accounts[0].createOrReplaceTempView("left_accounts")
    accounts[1].createOrReplaceTempView("right_accounts")
    c = compare("left_accounts", "right_accounts", "acct_id", spark=spark)
    assert (c.spec.left_name, c.row_counts().common) == ("left_accounts", 5)


def test_position(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(9)
    got = with_position(df, ["x"]).collect()
    assert len(got) == 1000 and all(r.position == r.x for r in got)


def test_stream_batches(spark, tmp_path, accounts):
    left, right = accounts
    left.write.parquet(f"{tmp_path}/in")
    seen = []
    query = reconcile(spark.readStream.schema(left.schema).parquet(f"{tmp_path}/in"), right, "acct_id", lambda c, n: seen.append((n, c.row_counts())), f"{tmp_path}/check")
    query.processAllAvailable()
    query.stop()
    assert [(n, r.common, r.left_only, r.right_only) for n, r in seen] == [(0, 5, 1, 0)]
    with pytest.raises(ValueError):
        reconcile(left, right, "acct_id", print)


def test_stream_keys_agree_as_in_the_comparison(spark, tmp_path):
    """Null keys, and keys that are equal once trimmed, aren't lost before a batch is compared."""
    schema = "K string, n int, v double"
    left = spark.createDataFrame([("a", 1, 1.0), (None, 2, 2.0), (" b ", 3, 3.0), ("c", None, 4.0), ("x", 9, 9.0)], schema)
    right = spark.createDataFrame([("a ", 1, 1.0), (None, 2, 2.0), ("b", 3, 3.0), ("c", None, 4.0), ("y", 8, 8.0)], schema.lower())
    left.coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    query = reconcile(spark.readStream.schema(left.schema).parquet(f"{tmp_path}/in"), right, ["k", "N"], lambda c, n: seen.append(c.row_counts()), ignore_spaces=True)
    query.processAllAvailable()
    query.stop()
    whole = compare(left, right.where("k <> 'y' or k is null"), ["k", "n"], ignore_spaces=True).row_counts()
    assert seen == [whole] and (whole.common, whole.left_only, whole.right_only, whole.unequal) == (4, 1, 0, 0)


def test_samples_in_one_pass(spark):
    """``samples`` are those of ``sample``, whatever the types, and the jobs don't grow with the columns."""
    n = 30
    cols = ", ".join(f"id * {k} as c{k}, cast(id + {k} as string) as s{k}, cast(id as double) / {k + 1} as d{k}" for k in range(n))
    left = spark.range(200).selectExpr("id", *cols.split(", "))
    right = left.select("id", *[F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col(c)).alias(c) for c in left.columns[1:]])
    c = compare(left, right, "id", unique_keys=True)
    found = c.samples(["c1", "s2", "d3", "C4"], 5)
    for name, got in found.items():
        assert got == [tuple(r) for r in c.sample(name, 5).collect()]
    assert c.samples([], 5) == {} and c.samples(["c1"], 0) == {"c1": []}
    with pytest.raises(ValueError):
        c.samples(["id"])

    def jobs(columns):
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"report-{len(columns)}", "")
        compare(left.select("id", *columns), right.select("id", *columns), "id", unique_keys=True).report()
        return len(tracker.getJobIdsForGroup(f"report-{len(columns)}"))

    assert jobs(left.columns[1:3]) == jobs(left.columns[1:])
    hidden = compare(left, right, "id", unique_keys=True)
    hidden.hide(["c1", "id"])
    assert hidden.samples(["c1"], 1) == {"c1": [("*******",) * 3]}
