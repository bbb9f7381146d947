"""Every query against its oracle on the smallest tables, and what the registry must look like."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from compare import difference, oracle_frame

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Queries that must not be checked here: those of the training-data subpackage, which has tests of its own.
OWN_TESTS = {n for n in QUERIES if n == "pipeline" or (n.startswith("op") and n[2:3].isdigit())}


def test_registry():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 80


@pytest.mark.parametrize("blocked", ["panelforge.llm", "xxhash", "corpus_pipeline"])
def test_a_missing_module_of_the_subpackage_costs_no_other_query(blocked):
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; print(len(e.queries()), sorted(n for n in e.queries() if n.startswith('op')), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert done.stdout.split()[0] == str(len(QUERIES.keys() - OWN_TESTS)) and "left out" in done.stderr


def test_entry(spark):
    flagship = entry.entry(spark)
    assert flagship.count() > 0 and "q1_mean" in flagship.columns


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES and n not in OWN_TESTS])
def test_query_equals_its_oracle(spark, sf, name):
    assert difference(QUERIES[name](spark, sf).toPandas(), oracle_frame(sf, ORACLES[name])) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES and n not in OWN_TESTS])
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
