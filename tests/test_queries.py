"""Every query of the core against its SQL, and plans without joins that multiply."""

import pytest
from compare import connection, same

from plenaria.plans import more, problems, reference

ALL = {**reference.QUERIES, **more.QUERIES, **problems.QUERIES}
SQL = {**reference.SQL, **more.SQL, **problems.SQL}


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, con, name):
    same(ALL[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name", ["embedding_clusters", "topic_clusters"])
def test_runs_without_sql(spark, data, name):
    assert ALL[name](spark, data).count() > 0


def test_every_query_has_sql_or_is_listed():
    rest = {"model_logistic", "model_stacked", "topic_clusters", "embedding_clusters"}
    assert set(ALL) - set(SQL) == rest


@pytest.mark.parametrize("name", ["link_flagship", "speaker_loyalty", "inverted_index", "p3_found", "p4_found"])
def test_no_multiplying_join(spark, data, name):
    plan = ALL[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = reference.QUERIES["active_parties"](spark, data)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1].split("]")[0]
    assert all(f in pushed for f in ("IsNull(DatumInactief)", "IsNotNull(AantalZetels)", "GreaterThan(AantalZetels,0)"))
    assert "NaamNL" not in plan.split("ReadSchema")[1]
