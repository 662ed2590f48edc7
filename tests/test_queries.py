"""Every registered query against its SQL on the smallest tables."""

import pytest

from answerloom.plans.catalog import ORACLES, QUERIES
from compare import compare, duck
from conftest import SF


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 17


@pytest.mark.parametrize("sf,pairs,curated,best", [("0.001", 34, 17, 11), ("0.01", 233, 126, 81)])
def test_known_row_counts(spark, sf, pairs, curated, best):
    d = f"/root/testdata/sf{sf}"
    assert QUERIES["qa_pairs"](spark, d).count() == pairs
    assert QUERIES["curated_split"](spark, d).count() == curated
    assert QUERIES["best_then_quality"](spark, d).count() == best
