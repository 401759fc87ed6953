"""Every registered query of the zone engine against its SQL (or, without one, that it gives rows)."""

import pytest
from oracle import oracle, spark_rows

from meridia.plans.queries import SQL, Q


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, sf, name):
    df = Q[name](spark, sf)
    if name in SQL:
        assert spark_rows(df) == oracle(SQL[name], sf)
    else:
        assert df.count() > 0
