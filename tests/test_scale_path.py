"""The 100 TB plan shape (no broadcasts: sort-merge joins on co-partitioned
inputs) gives the same results as the small-data plan."""

import pytest

from polyrisk.operators import contingency as C
from polyrisk.operators import patterns as PT
from polyrisk.sources import tables
from tests.conftest import SF_SMALL

NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture()
def no_broadcast(spark):
    old = {k: spark.conf.get(k, None) for k in NO_BROADCAST}
    for k, v in NO_BROADCAST.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _snapshot(spark):
    eps = tables.episodes(spark, SF_SMALL, "brand")
    return (
        sorted((r.subject_id, r.episode_id, r.outcome, tuple(r.combo)) for r in eps.collect()),
        sorted(map(tuple, tables.exposures(spark, SF_SMALL, "brand").collect())),
        sorted(map(tuple, PT.attach_risk(eps, PT.combo_patterns(eps)).select("episode_id", "risk").collect())),
        sorted(map(tuple, C.code_contingency(eps).collect())),
    )


def test_sort_merge_path_equals_broadcast_path(spark, no_broadcast):
    scale = _snapshot(no_broadcast)
    plan = tables.episodes(no_broadcast, SF_SMALL, "brand")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    for k, v in NO_BROADCAST.items():
        spark.conf.unset(k)
    small = _snapshot(spark)
    assert scale == small
