import pytest

from gristmill.llm.registry import QUERIES, SQL
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", list(SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, name, sf):
    d = f"/root/testdata/{sf}"
    assert compare(spark, connect(d), d, QUERIES[name], SQL[name])
