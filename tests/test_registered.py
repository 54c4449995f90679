"""Every registered query against its DuckDB twin (the driver's gate), plus the entry smoke check."""

import pytest

import __spark_entry__ as entry_module
from meterkit.checks import registered
from meterkit.checks.compare import compare

from conftest import SF_SMALL

QUERIES = {name: entry_module.queries()[name] for name in registered.queries()}
ORACLE = registered.oracle_sql()


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(ORACLE) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_smoke(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["windowstart", "windowend", "value", "organization"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, name):
    result = compare(QUERIES[name](spark, SF_SMALL), ORACLE[name], SF_SMALL)
    assert result["columns_match"], result
    assert result["values_match"], result
