"""Every query of the catalog against the same arithmetic in DuckDB."""

import pytest

from pointmill import catalog
from tests.compare import duck, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    if name not in catalog.ORACLES:
        assert catalog.QUERIES[name](spark, SF).count() >= 0
        return
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == duck_rows(con, catalog.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).collect()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
