import pytest

import __spark_entry__ as entry
from tests.run_checks import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_contract():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns[0] == "conv_id" and got.count() > 0


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    _, _, verdict, detail = compare(spark, duck, FOLDER, name, QUERIES[name], SQL.get(name))
    assert verdict in ("ok", "rows only"), detail
