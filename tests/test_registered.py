"""Every registered query of the core against its SQL."""

import pytest

from sylloge.plans import registry
from tests.conftest import SF, same_rows


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        same_rows(df, duck, registry.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_names_match():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 150
