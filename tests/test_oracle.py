"""Every query that SQL can express gives DuckDB's rows; every other one runs and has rows."""

from __future__ import annotations

import pytest

from tests.conftest import SF, same
from vigilog.plans import registry

registry.load()
#: Empty at the smallest scale.
MAY_BE_EMPTY = {"f5_detect_rce_output"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck.execute(registry.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
