"""Every query against its SQL on the smallest tables; the others run and give rows."""

import pytest

import oracle
from lexitide.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return oracle.database(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, con, name):
    assert oracle.difference(registry.QUERIES[name](spark, sf), con, registry.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_others_give_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["_id", "z_quality", "z_toxic", "z_median"] and out.count() > 0
