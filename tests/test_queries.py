import pytest
from tablewright import queries as Q
from tests.parity import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = same(spark, duck, Q.QUERIES[name], Q.ORACLE_SQL[name], SF)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_report_lines(spark):
    lines = [r.line for r in Q.QUERIES["report_lines"](spark, SF).orderBy("n").collect()]
    assert "Matched on: o_orderkey" in lines and "Column Summary" in lines


def test_cell_diff_of_numbers_and_times(spark):
    from tablewright import compare

    sides = ["SELECT * FROM VALUES (1L, 1.5D, TIMESTAMP_NTZ'1996-01-02 00:00:00'), (2L, 1234567.25D, TIMESTAMP_NTZ'1996-12-01 10:20:30'), (3L, CAST(NULL AS DOUBLE), NULL) AS t(k, price, at)", "SELECT * FROM VALUES (1L, 2.0D, TIMESTAMP_NTZ'1996-01-02 00:00:00'), (2L, 1234567.25D, TIMESTAMP_NTZ'1996-12-01 10:20:31.5'), (3L, -0.25D, NULL) AS t(k, price, at)"]
    left, right = (spark.sql(x).select("k", "price", "at") for x in sides)
    got = sorted(map(tuple, compare(left, right, "k").cell_diff().collect()))
    assert got == [(1, "price", "1.5", "2.0"), (2, "at", "1996-12-01 10:20:30", "1996-12-01 10:20:31.5"), (3, "price", None, "-0.25")]


def test_cell_diff_has_all_planted_cells(spark):
    c = Q.orders(spark, SF)
    stats = {r["column"]: r.unequal_cnt for r in c.column_stats_frame().collect() if r.unequal_cnt}
    found = {r["column"]: r["count"] for r in c.cell_diff().groupBy("column").count().collect()}
    assert found == stats and {"o_totalprice", "o_orderdate"} <= found.keys()
