"""Every registered query runs on the smallest tables and gives what its SQL gives, where it has any."""

import pytest
from helpers import SF, same_rows

from vicinal.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF), duck, registry.ORACLE_SQL[name])


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
