"""Every query of the catalogue against its independent SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from pricewright.plans import catalog, oracles
from tests.conftest import DATA
from tests.oracle import assert_same

FOLDER = f"{DATA}/sf0.001"


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    assert_same(catalog.queries()[name](spark, FOLDER), FOLDER, oracles.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())
