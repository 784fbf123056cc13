"""Every query of the catalogue against its SQL."""

import pytest
from same import rows

from tessera.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck.sql(SQL[name]).df())
    else:
        assert len(got)
