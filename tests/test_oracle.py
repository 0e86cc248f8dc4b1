import pytest

from gristmill.plans import queries as base
from tests.oracle import compare, connect

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(base.SQL))
def test_matches_sql(spark, name):
    compare(spark, connect(DIR), DIR, base.QUERIES[name], base.SQL[name])


def test_rows_only(spark):
    assert base.page_text(spark, DIR).count() == 250
