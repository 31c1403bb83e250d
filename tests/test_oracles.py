"""Every query with SQL gives the SQL's rows; the others run."""

import pytest

from gleaner.plans.oracles import ORACLES
from gleaner.plans.queries import QUERIES


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, oracle, same):
    found = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        same(oracle(ORACLES[name]), found)
    else:
        assert len(found) > 0
