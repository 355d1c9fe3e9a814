import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyrisk.operators import describe as D


def test_box_stats_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=200), [8.0, -9.0]])
    df = spark.createDataFrame([(1, float(v)) for v in values], "g int, x double")
    row = D.box_stats(df, "x", "g").first()
    q1, med, q3 = np.percentile(values, [25, 50, 75])
    iqr = q3 - q1
    inside = values[(values >= q1 - 1.5 * iqr) & (values <= q3 + 1.5 * iqr)]
    assert row.q1 == pytest.approx(q1) and row.median == pytest.approx(med) and row.q3 == pytest.approx(q3)
    assert row.whisker_lo == inside.min() and row.whisker_hi == inside.max()
    assert row.n_outliers == len(values) - len(inside)


def test_kde_matches_gaussian_sum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    df = spark.createDataFrame([(0.5, float(v)) for v in x] + [(1.0, 0.0)] * 5, "fraction double, error double")
    got = D.kernel_density(df, "error", "fraction", grid_size=50).orderBy("grid_index").collect()
    assert {r.fraction for r in got} == {0.5}  # zero-variance group has no density
    bw = x.std(ddof=1) * len(x) ** (-0.2)
    grid = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 50)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / bw) ** 2).sum(1) / (len(x) * bw * math.sqrt(2 * math.pi))
    assert np.allclose([r.x for r in got], grid)
    assert np.allclose([r.density for r in got], dens)
    assert np.trapezoid(dens, grid) == pytest.approx(1.0, abs=1e-3)


def test_running_best_and_ranks(spark):
    trials = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.4), (3, 0.45)], "trial_id int, value double")
    got = [r.best_value for r in D.running_best(trials).orderBy("trial_id").collect()]
    assert got == [0.5, 0.5, 0.4, 0.4]


def test_ranked_curves(golden_episodes):
    from polyrisk.operators.contingency import code_contingency

    curve = D.ranked_probability_curve(code_contingency(golden_episodes)).orderBy("rank").collect()
    assert [r.code for r in curve] == ["D", "B", "A", "C"]


@pytest.mark.parametrize("sketch", [10_000, 40, 20])
def test_exact_quantiles_match_numpy(spark, sketch):
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.normal(size=2000), np.zeros(900)])  # a hot repeated value
    b = rng.exponential(size=41)
    df = spark.createDataFrame([(0.5, float(v)) for v in a] + [(1.0, float(v)) for v in b], "fraction double, error double")
    probs = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = {(r.fraction, r.prob): r.value for r in D.exact_quantiles(df, "error", "fraction", probs, sketch=sketch).collect()}
    for frac, data in ((0.5, a), (1.0, b)):
        for p in probs:
            assert got[(frac, p)] == pytest.approx(np.percentile(data, p * 100), abs=1e-12)


def test_exact_quantiles_of_many_groups_nan_and_wide_values(spark):
    rows = [(g, float(v)) for g in range(1_500) for v in (g, g + 1, g + 4)]
    rows += [(-1, float("nan")), (-1, 2.0), (None, 7.0)]
    wide = [-1.7e308, -1.0, 0.0, 2.0, 1.7e308]
    rows += [(-2, v) for v in wide]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {(r.g, r.prob): r.value for r in D.exact_quantiles(df, "x", "g", (0.5, 0.75), sketch=2).collect()}
    assert len(got) == 2 * 1_503
    assert all(got[(g, 0.5)] == g + 1 and got[(g, 0.75)] == g + 2.5 for g in range(1_500))
    assert got[(-1, 0.5)] == 2.0 and got[(None, 0.5)] == 7.0
    assert got[(-2, 0.5)] == 0.0 and got[(-2, 0.75)] == 2.0
    with pytest.raises(ValueError):
        D.exact_quantiles(spark.createDataFrame([(1, float("inf"))], "g int, x double"), "x", "g", (0.5,))


def test_quantiles_read_a_bracket_only(spark):
    """Of a large group, few distinct values are counted one by one; a plan without a group's rows in one task."""
    from scripts.plan_report import executed_plan

    n = 60_000
    df = spark.range(n).select((F.col("id") % 2 * 0).alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("x")).repartition(6)
    got = {r.prob: r.value for r in D.exact_quantiles(df, "x", "g", (0.1, 0.5, 0.99), sketch=100).collect()}
    assert got == {p: pytest.approx(p * (n - 1)) for p in (0.1, 0.5, 0.99)}
    out = D._bracketed_quantiles(D._numbers(df, "x", "g"), (0.5,), 100)
    assert "SinglePartition" not in executed_plan(out)
