from __future__ import annotations

import pytest

from support import rows_of
from exceedra.plans import aggregates, chains, files, networks, spatial, stored, streams  # noqa: F401  (they register their queries)
from exceedra.plans.queries import Q, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, data, duck):
    got = rows_of(Q[name](spark, data).toArrow())
    want = rows_of(duck.sql(SQL[name]).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
