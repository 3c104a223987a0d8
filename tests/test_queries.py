from __future__ import annotations

import pytest
from oracle import compare, connect

from tessera.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLE_SQL:
        assert compare(spark, con, QUERIES[name], ORACLE_SQL[name], SF) == ""
    else:
        assert QUERIES[name](spark, SF).count() >= 0
