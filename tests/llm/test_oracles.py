"""Queries whose whole result SQL expresses, held against that SQL over whole tables."""

import pytest
from harness import compare, duck

from labelforge.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    out = compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF)
    assert out["spark_rows"] > 0 and out["hash_match"], out
