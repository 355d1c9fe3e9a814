"""Places and running values over sorted ranges."""

import random

import pytest
from pyspark.sql import functions as F

from polyrisk.operators.describe import rank_codes, running_best
from polyrisk.operators.scan import ranked, running_min
from scripts.plan_report import executed_plan


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 0.5, 1.5, 2.5]), rng.choice([None, *range(-50, 50)])) for i in range(500)]
    return rows, spark.createDataFrame(rows, "id int, x double, v int").repartition(7)


def test_ranked_is_the_place_in_the_whole_order(table):
    rows, df = table
    got = {r.id: r.rank for r in ranked(df, [F.desc_nulls_last("x"), F.asc("id")]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: i for i, r in enumerate(order)}


def test_running_min(table):
    rows, df = table
    got = {r.id: r.low for r in running_min(df, [F.asc("id")], "v", "low").collect()}
    low, want = None, {}
    for i, _, v in rows:
        low = v if low is None else low if v is None else min(low, v)
        want[i] = low
    assert got == want


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "id int, v int")
    assert ranked(none, [F.asc("id")]).count() == 0
    assert running_min(none, [F.asc("id")], "v", "low").count() == 0
    one = spark.createDataFrame([(3, None)], "id int, v int")
    assert [tuple(r) for r in ranked(one, [F.asc("id")], start=1).collect()] == [(3, None, 1)]
    assert [tuple(r) for r in running_min(one, [F.asc("id")], "v", "low").collect()] == [(3, None, None)]


def test_no_single_partition_exchange(spark, table):
    _, df = table
    codes = df.select(F.col("id").cast("string").alias("code"), "x")
    trials = df.select(F.col("id").alias("trial_id"), F.col("x").alias("value"))
    for out in (rank_codes(codes, [F.asc_nulls_last("x")]), running_best(trials)):
        assert "SinglePartition" not in executed_plan(out)
