"""Every registered query gives the rows of its oracle SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks import all_checks, compare

# These contain the run metrics as a part and are compared at the larger scale only.
LARGE = {"aggregate_runs", "readiness_indices", "summary"}


def test_every_query_has_an_oracle():
    assert set(all_checks.QUERIES) == set(all_checks.ORACLES)


@pytest.mark.parametrize("name", [n for n in all_checks.QUERIES if n not in LARGE])
def test_query_equals_oracle(spark, con, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    assert compare.compare(df, con, entry.oracle_sql()[name]) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
