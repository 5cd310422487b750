"""Every registered query of the engine runs, and gives what its SQL gives."""

import pytest
from helpers import SF, same_rows

from vicinal.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        same_rows(df, duck, registry.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
