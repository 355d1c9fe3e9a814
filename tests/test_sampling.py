import pytest
from pyspark.sql import functions as F

from polyrisk.operators import sampling as S
from polyrisk.operators.patterns import combo_patterns
from polyrisk.sources import tables

SF = "/root/testdata/sf0.001"


def test_group_sample_keeps_whole_combinations(spark):
    eps = tables.episodes(spark, SF, "brand")
    picked = S.group_sample(eps, 0.4, 40)
    rest = S.holdout_unseen(eps, 0.4, 40)
    assert picked.count() + rest.count() == eps.count()
    assert picked.select("combo").intersect(rest.select("combo")).count() == 0


def test_group_sample_is_deterministic(spark):
    eps = tables.episodes(spark, SF, "brand")
    a = sorted(r.episode_id for r in S.group_sample(eps, 0.5, 7).collect())
    b = sorted(r.episode_id for r in S.group_sample(eps.repartition(5), 0.5, 7).collect())
    assert a == b


def test_kfold_each_combination_in_one_fold(spark):
    """I8."""
    pt = S.kfold_assign(combo_patterns(tables.episodes(spark, SF, "brand")), 3, 40)
    counts = pt.groupBy("combo").agg(F.countDistinct("fold").alias("k")).where("k != 1").count()
    assert counts == 0
    sizes = [r["count"] for r in pt.groupBy("fold").count().collect()]
    assert len(sizes) == 3 and min(sizes) > 0.25 * sum(sizes)


def test_sampling_error_zero_at_full_fraction(spark):
    """I4: the error is exactly 0 at fraction 1."""
    err = S.sampling_error(tables.episodes(spark, SF, "type"), (0.5, 1.0), seed=42)
    full = err.where("fraction = 1.0")
    assert full.count() > 0
    assert full.where("error != 0").count() == 0
    assert err.where("fraction = 0.5").count() > 0


def test_sampling_error_matches_two_pass_definition(spark):
    """Single-pass conditional aggregation equals sample -> risk -> join."""
    eps = tables.episodes(spark, SF, "type")
    one = {(r.combo and tuple(r.combo), r.fraction): r.error for r in S.sampling_error(eps, (0.25,), 42).collect()}
    frequent = eps.join(
        combo_patterns(eps).where("n > 2").select(F.col("combo").alias("c")), F.col("combo") == F.col("c"), "left_semi"
    )
    full = combo_patterns(frequent)
    sample = combo_patterns(S.row_sample(frequent, 0.25, 42)).select(F.col("combo").alias("c"), F.col("risk").alias("rs"))
    two = {
        (tuple(r.combo), 0.25): r.risk - r.rs
        for r in full.join(sample, full.combo == sample.c).collect()
    }
    assert one == two


def test_exact_row_sample_size_and_order(spark):
    """J2 exact-n: exactly round(f * n) episodes, the smallest (bucket, second bucket, key)."""
    import hashlib

    eps = tables.episodes(spark, SF, "brand")
    rows = eps.select("subject_id", "episode_id", "outcome").collect()
    n = len(rows)

    def order_key(r, seed=42):
        key = f"{r.subject_id}|{r.episode_id}|{r.outcome}"
        d = hashlib.md5(f"{seed}|{key}".encode()).hexdigest()
        return (int(d[:8], 16), int(d[8:16], 16), key)

    ranked = sorted(rows, key=order_key)
    for f in (0.25, 1 / 3, 0.5, 0.999):
        k = round(f * n)
        got = {r.episode_id for r in S.exact_row_sample(eps, f, 42).collect()}
        assert len(got) == k
        assert got == {r.episode_id for r in ranked[:k]}
    assert S.exact_row_sample(eps, 0.0, 42).count() == 0
    assert S.exact_row_sample(eps, 1.0, 42).count() == n


def test_exact_kfold_sizes(spark):
    pt = S.kfold_assign_exact(combo_patterns(tables.episodes(spark, SF, "brand")), 3, 40)
    n = pt.count()
    sizes = sorted((r.fold, r["count"]) for r in pt.groupBy("fold").count().collect())
    assert sizes == [(i, n // 3 + (1 if i < n % 3 else 0)) for i in range(3)]
    assert pt.groupBy("combo").agg(F.countDistinct("fold").alias("k")).where("k != 1").count() == 0


def test_sampling_error_exact_sizes(spark):
    from polyrisk.operators.patterns import frequent_episodes

    eps = tables.episodes(spark, SF, "type")
    n = frequent_episodes(eps, 2).count()
    err = S.sampling_error(eps, (0.25, 0.5, 1.0), seed=42, exact=True)
    sizes = {r.fraction: r.s for r in err.groupBy("fraction").agg(F.sum("n_sample").alias("s")).collect()}
    assert sizes == {f: round(f * n) for f in (0.25, 0.5, 1.0)}
    assert err.where("fraction = 1.0 AND error != 0").count() == 0


def test_group_sample_exact_count_of_combinations(spark):
    eps = tables.episodes(spark, SF, "brand")
    m = eps.select("combo").distinct().count()
    for f in (0.4, 0.5):
        picked = S.group_sample_exact(eps, f, 40)
        assert picked.select("combo").distinct().count() == round(f * m)
        # whole combinations only
        full = eps.join(picked.select("combo").distinct(), "combo").count()
        assert full == picked.count()


def test_exact_samples_with_conflicting_outcomes(spark):
    eps = spark.createDataFrame(
        [(i, i, o, [f"C{i % 3}"], 1) for i in range(40) for o in (0, 1)],
        "subject_id long, episode_id long, outcome int, combo array<string>, n_codes int",
    )
    for f in (25 / 80, 41 / 80, 57 / 80):
        assert S.exact_row_sample(eps, f, 42).count() == round(f * 80)
        err = S.sampling_error(eps, (f,), seed=42, exact=True)
        assert err.agg(F.sum("n_sample")).first()[0] == round(f * 80)


def test_a_delimiter_in_a_code_does_not_join_combinations(spark):
    combos = [["A|B"], ["A", "B"], ["A\\pB"], ["A\\", "B"], [""], []]
    eps = spark.createDataFrame([(i, i, 0, c, len(c)) for i, c in enumerate(combos)],
                                "subject_id long, episode_id long, outcome int, combo array<string>, n_codes int")
    for f in (1 / 6, 0.5, 5 / 6):
        assert S.group_sample_exact(eps, f, 40).count() == round(f * 6)
        assert S.holdout_unseen_exact(eps, f, 40).count() == 6 - round(f * 6)


def test_exact_folds_of_groups(spark):
    """Many risks of one combination: groups are the distinct keys, not the rows."""
    rows = [(["A"], i / 16, 1) for i in range(15)] + [([f"B{i}"], 0.5, 1) for i in range(6)]
    df = spark.createDataFrame(rows, "combo array<string>, risk double, n long")
    whole = S.kfold_assign_exact(df, 3, 40)
    assert whole.groupBy("combo").agg(F.countDistinct("fold").alias("k")).where("k != 1").count() == 0
    groups = whole.select("combo", "fold").distinct().groupBy("fold").count().collect()
    assert sorted((r.fold, r["count"]) for r in groups) == [(0, 3), (1, 2), (2, 2)]
    pairs = S.kfold_assign_exact(df, 3, 40, risk_col="risk").groupBy("fold").count().collect()
    assert sorted((r.fold, r["count"]) for r in pairs) == [(0, 7), (1, 7), (2, 7)]
    with pytest.raises(ValueError):
        S.kfold_assign_exact(df.limit(2), 3, 40, risk_col="risk")


def test_exact_row_sample_of_text_ids_with_marks_and_nulls(spark):
    """Ids that read alike when joined, and null ids, are different episodes."""
    rows = [(a, b, i % 2, ["c"], 1) for i in range(10) for a, b in ((f"{i}|2", "3"), (f"{i}", "2|3"), (None, f"{i}"), (f"{i}", None))]
    eps = spark.createDataFrame(rows, "subject_id string, episode_id string, outcome int, combo array<string>, n_codes int")
    for fraction, want in ((11 / 40, 11), (25 / 40, 25), (1.0, 40)):
        sample = S.exact_row_sample(eps, fraction, 3)
        assert sample.count() == want == sample.distinct().count()
    full = S.sampling_error(eps, (0.5,), 3, exact=True).collect()
    assert [(r.n, r.n_sample) for r in full] == [(40, 20)]
