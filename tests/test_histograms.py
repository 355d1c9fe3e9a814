from pyspark.sql import functions as F

from polyrisk.operators import histograms as H
from polyrisk.operators.episodes import build_episodes, non_empty


def test_golden_co_exposure(golden_episodes):
    hist = {r.code: r for r in H.co_exposure_histogram(non_empty(golden_episodes)).collect()}
    assert (hist["A"].count_1, hist["A"].count_2) == (3, 2)
    assert (hist["B"].count_1, hist["B"].count_2) == (1, 2)
    assert hist["C"].count_1 == 1 and hist["D"].count_1 == 1
    assert sum(hist["A"][f"count_{i}"] for i in range(3, 21)) == 0


def test_co_exposure_drops_sizes_above_20(spark):
    rows = [(1, "big", f"C{i:02d}", 1) for i in range(21)] + [(2, "small", "C00", 0)]
    eps = build_episodes(spark.createDataFrame(rows, "subject_id long, episode_id string, code string, outcome int"))
    hist = {r.code: r for r in H.co_exposure_histogram(eps).collect()}
    assert hist["C00"].count_1 == 1
    assert sum(hist["C05"][f"count_{i}"] for i in range(1, 21)) == 0


def test_co_exposure_identity(spark):
    """For each size i <= 20, sum over codes of count_i = i * #episodes of size i."""
    from polyrisk.sources import tables

    eps = tables.episodes(spark, "/root/testdata/sf0.001", "brand")
    hist = H.co_exposure_histogram(eps)
    sums = hist.agg(*[F.sum(f"count_{i}").alias(f"s{i}") for i in range(1, 21)]).first()
    sizes = {r.n_codes: r.episodes for r in H.record_size_histogram(eps).collect()}
    for i in range(1, 21):
        assert sums[f"s{i}"] == i * sizes.get(i, 0)


def test_golden_record_sizes(golden_episodes):
    ne = non_empty(golden_episodes)
    plain = {r.n_codes: r.episodes for r in H.record_size_histogram(ne).collect()}
    quirk = {r.n_codes: r.episodes for r in H.record_size_histogram(ne, include_outcome=True).collect()}
    assert plain == {1: 6, 2: 2}
    assert quirk == {1: 3, 2: 4, 3: 1}


def test_golden_codes_per_episode_by_class(spark, golden_episodes):
    kept = spark.createDataFrame([("B",)], "code string")
    sizes = H.codes_per_episode(golden_episodes, kept)
    got = {(r.n_codes, r.outcome): r.episodes for r in H.size_by_class(sizes).collect()}
    assert got == {(1, 1): 2, (1, 0): 1}


def test_equal_width_histogram_matches_numpy(spark):
    import numpy as np

    values = [1, 1, 2, 3, 3, 3, 5, 8, 8, 13]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "n_codes int, outcome int")
    got = {r.bin: r.episodes for r in H.equal_width_histogram(df, "n_codes").collect()}
    k = len(set(values))
    counts, _ = np.histogram(values, bins=k)
    assert [got.get(b, 0) for b in range(1, k + 1)] == counts.tolist()
    by_class = H.equal_width_histogram(df, "n_codes", "outcome").agg(F.sum("episodes")).first()[0]
    assert by_class == len(values)


def test_equal_width_zero_range(spark):
    df = spark.createDataFrame([(4,), (4,)], "n_codes int")
    rows = H.equal_width_histogram(df, "n_codes").collect()
    assert [(r.bin, r.episodes) for r in rows] == [(1, 2)]
