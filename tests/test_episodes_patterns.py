from pyspark.sql import functions as F

from polyrisk.operators import episodes as E
from polyrisk.operators import patterns as PT
from polyrisk.sources import tables
from tests.conftest import SF_SMALL


def _patterns(golden_episodes):
    rows = PT.combo_patterns(golden_episodes).collect()
    return {tuple(r.combo): (r.n, r.n_pos, r.risk) for r in rows}


def test_golden_patterns(golden_episodes):
    got = _patterns(golden_episodes)
    assert got == {
        (): (1, 1, 1.0),
        ("A",): (3, 1, 1 / 3),
        ("A", "B"): (2, 1, 0.5),
        ("B",): (1, 1, 1.0),
        ("C",): (1, 0, 0.0),
        ("D",): (1, 1, 1.0),
    }


def test_null_key_dropped_and_null_code_kept(golden_episodes):
    rows = golden_episodes.collect()
    assert all(r.subject_id is not None for r in rows)
    empty = [r for r in rows if r.n_codes == 0]
    assert [(r.subject_id, r.outcome) for r in empty] == [(7, 1)]
    assert E.non_empty(golden_episodes).count() == 8


def test_conflicting_outcomes_give_two_episodes(spark):
    df = spark.createDataFrame(
        [(1, "e", "A", 0), (1, "e", "B", 1), (1, "e", "A", 1)], "subject_id long, episode_id string, code string, outcome int"
    )
    eps = {(r.outcome, tuple(r.combo)) for r in E.build_episodes(df).collect()}
    assert eps == {(0, ("A",)), (1, ("A", "B"))}


def test_invariant_totals(golden_episodes):
    """Sum n over patterns = #episodes; sum n_pos = sum outcome."""
    pt = PT.combo_patterns(golden_episodes).agg(F.sum("n"), F.sum("n_pos")).first()
    ep = golden_episodes.agg(F.count(F.lit(1)), F.sum("outcome")).first()
    assert tuple(pt) == tuple(ep)


def test_invariant_shuffle_duplicates_repartition(spark, golden):
    """Result unchanged under row shuffle, duplicate rows and repartition."""
    base = _patterns(E.build_episodes(golden))
    noisy = golden.unionByName(golden).repartition(7).orderBy(F.rand(3))
    assert _patterns(E.build_episodes(noisy)) == base


def test_attach_risk_and_frequency(golden_episodes):
    rows = PT.attach_risk(golden_episodes, PT.combo_patterns(golden_episodes)).collect()
    by_subject = {r.subject_id: r.risk for r in rows}
    assert by_subject[3] == by_subject[4] == by_subject[6] == 1 / 3
    assert by_subject[1] == 0.5
    frequent = PT.frequent_episodes(golden_episodes, min_count=2).collect()
    assert sorted(r.subject_id for r in frequent) == [3, 4, 6]
    freq = {(tuple(r.combo), r.risk): r.n for r in PT.risk_frequency(PT.attach_risk(golden_episodes, PT.combo_patterns(golden_episodes))).collect()}
    assert freq[(("A",), 1 / 3)] == 3


def test_tpch_episode_builder_matches_generic(spark):
    fast = tables.episodes(spark, SF_SMALL, "type")
    generic = E.build_episodes(tables.exposures(spark, SF_SMALL, "type"))
    assert fast.count() == generic.count()
    assert fast.exceptAll(generic.select(*fast.columns)).count() == 0


def test_dataset_profile(spark):
    row = E.dataset_profile(tables.exposure_rows(spark, SF_SMALL, "brand"), tables.episodes(spark, SF_SMALL, "brand")).first()
    assert row.n_rows_raw == 6000  # every sf0.001 line item joins
    assert row.n_exposures == tables.exposures(spark, SF_SMALL, "brand").count()
    assert row.n_outcome_0 + row.n_outcome_1 == row.n_episodes


def test_exposures_equal_distinct_raw_rows_with_null_codes(spark, tmp_path):
    """E1 from per-order sets equals DISTINCT over the raw join, NULL codes included."""
    root = str(tmp_path)
    spark.createDataFrame(
        [(1, "A", "T"), (2, None, "T"), (3, "B", None)], "p_partkey long, p_brand string, p_type string"
    ).write.parquet(f"{root}/part.parquet")
    spark.createDataFrame(
        [(10, 7, "F"), (11, 8, "O"), (12, 9, "O")], "o_orderkey long, o_custkey long, o_orderstatus string"
    ).write.parquet(f"{root}/orders.parquet")
    spark.createDataFrame(
        [(10, 1), (10, 2), (10, 1), (11, 2), (12, 3), (12, 1)], "l_orderkey long, l_partkey long"
    ).write.parquet(f"{root}/lineitem.parquet")
    for code in ("brand", "type"):
        fast = tables.exposures(spark, root, code)
        slow = tables.exposure_rows(spark, root, code).distinct()
        assert sorted(map(tuple, fast.collect()), key=repr) == sorted(map(tuple, slow.collect()), key=repr)
    eps = {r.episode_id: tuple(r.combo) for r in tables.episodes(spark, root, "brand").collect()}
    assert eps == {10: ("A",), 11: (), 12: ("A", "B")}


def test_null_keys_count_as_rows_but_make_no_episode(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 2), (4, 1), (None, 1)], "l_orderkey bigint, l_partkey bigint").write.parquet(f"{sf}/lineitem.parquet")
    spark.createDataFrame([(1, "A"), (2, None)], "p_partkey bigint, p_brand string").write.parquet(f"{sf}/part.parquet")
    orders = [(1, 10, "F"), (2, None, "O"), (3, 11, "O"), (4, 12, None)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").write.parquet(f"{sf}/orders.parquet")
    rows = tables.exposure_rows(spark, sf)
    distinct = {tuple(r) for r in tables.exposures(spark, sf).collect()}
    assert distinct == {tuple(r) for r in rows.distinct().collect()}
    assert distinct == {(10, 1, "A", 1), (None, 2, "A", 0), (11, 3, None, 0), (12, 4, "A", None)}
    got = {tuple(r) for r in tables.episodes(spark, sf).select("subject_id", "outcome", "n_codes").collect()}
    assert got == {(10, 1, 1), (11, 0, 0)}
    assert tables.distinct_row_count(spark, sf).first().n_exposures == 4
    assert tables.raw_row_count(spark, sf).first().n_rows_raw == 5
