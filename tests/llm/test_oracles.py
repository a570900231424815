"""Every registered query that SQL can express, on the smallest tables."""

from __future__ import annotations

import pytest

from pricewright.llm import queries as q
from tests.conftest import DATA
from tests.oracle import assert_same

FOLDER = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query(spark, name):
    assert_same(q.queries()[name](spark, FOLDER), FOLDER, q.oracle_sql()[name])


def test_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in q.queries()) == list(range(1, 14))
