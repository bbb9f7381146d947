"""Queries of the subpackage against their SQL, and what the registry must look like."""

import pytest

import __spark_entry__ as entry
from compare import difference, oracle_frame

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_every_operator_and_the_pipeline_are_registered():
    assert all(sum(name.startswith(f"op{n}_") for name in QUERIES) == 1 for n in range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n.startswith("op")))
def test_query_equals_its_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf).toPandas(), oracle_frame(sf, ORACLES[name])) is None
