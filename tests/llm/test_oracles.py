import pytest
from tablewright.llm import registry
from tests.parity import connect, same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    got, want = same(spark, connect(folder), registry.QUERIES[name], registry.ORACLE_SQL[name], folder)
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert got[1] == want[1]
