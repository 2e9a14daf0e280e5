"""Every registered query against its SQL; those without SQL give rows."""

import pytest

from quillspark.plans import registry
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, data, name):
    same(spark, data, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_recall_of_approximate_search(spark, data):
    """Of the exact five best, without each query's own vector."""
    found, best = ({(r.qid, r.vec_id) for r in registry.QUERIES[name](spark, data).collect() if r.qid != r.vec_id} for name in ("top02_approximate_top5", "top01_exact_top5"))
    assert best and len(found & best) >= 0.9 * len(best)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
