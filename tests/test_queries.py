"""Every core query against its SQL, over the whole tables of the smallest scale."""

from __future__ import annotations

import pytest
from oracle import differs

from evalanvil.plans import evaluation, problems, reference

QUERIES = {**problems.QUERIES, **reference.QUERIES, **evaluation.QUERIES}
ORACLES = {**problems.ORACLES, **reference.ORACLES, **evaluation.ORACLES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    assert differs(QUERIES[name](spark, sf), ORACLES[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
