"""Every registered query against its SQL at the smallest scale that still passes the gates."""

from functools import lru_cache

import pytest
from pyspark.sql import DataFrameWriter

import __spark_entry__ as entry
from tests.compare import compare, oracle_connection
from vigilseries.plans import catalog

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(SF)


@pytest.fixture(scope="module", autouse=True)
def one_training_run():
    """The queries share their stage tables here; each builds its own elsewhere."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(catalog, "training", lru_cache(maxsize=None)(catalog.training))
        yield


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written_plans(monkeypatch):
    """Plans of everything a query writes on its way."""
    plans, write = [], DataFrameWriter.parquet

    def spy(writer, *args, **kwargs):
        plans.append(plan_of(writer._df))
        return write(writer, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    return plans


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, written_plans, name):
    frame = QUERIES[name](spark, SF)
    got = frame.toPandas()
    assert len(got.columns) > 0
    for plan in [*written_plans, plan_of(frame)]:
        for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert costly not in plan
    if name in ORACLES:
        assert compare(got, duck.execute(ORACLES[name]).df()) is None
    else:
        assert len(got) > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["method"] for r in rows} == {"nsa", "kmeans"}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
