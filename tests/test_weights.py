"""Weight tables: fit against Newton steps, scores and losses by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyrisk.ml import weights as W
from polyrisk.plans.scoring import fold_losses, score_episodes

SCHEMA = "combo array<string>, n long, n_pos long, risk double"


def patterns_of(seed, codes=5, count=24):
    rng = random.Random(seed)
    seen = {}
    for _ in range(count):
        combo = tuple(sorted(rng.sample([f"c{i}" for i in range(codes)], rng.randrange(codes))))
        n = rng.randrange(4, 40)
        seen[combo] = (n, rng.randrange(1, n))
    return [(list(c), n, p, p / n) for c, (n, p) in seen.items()]


def newton(rows, codes=5):
    """(intercept and weights) of the maximum likelihood fit."""
    x = np.array([[1.0] + [float(f"c{i}" in c) for i in range(codes)] for c, *_ in rows])
    n, pos = (np.array([r[i] for r in rows], float) for i in (1, 2))
    w = np.zeros(codes + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]), x.T @ (n * p - pos))
    return w


def as_dict(weights):
    return {r.code: r.weight for r in weights.collect()}


def test_fit_is_the_optimum(spark):
    rows = patterns_of(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    weights = W.fit_logistic_weights(df)
    got, want = as_dict(weights), newton(rows)
    assert [got[None]] + [got[f"c{i}"] for i in range(5)] == pytest.approx(list(want), abs=1e-6)
    gradient = W.loss_gradient(df, weights).collect()
    assert len(gradient) == 6 and max(abs(r.gradient) for r in gradient) < 1e-8
    moved = weights.withColumn("weight", F.col("weight") + 0.1)
    assert max(abs(r.gradient) for r in W.loss_gradient(df, moved).collect()) > 1e-3


def test_split_patterns_fit_alike(spark):
    """Rows of one combination (risk variants after alignment) count together."""
    rows = patterns_of(2)
    halves = [(c, n - 1, max(p - 1, 0), 0.0) for c, n, p, _ in rows] + [(c, 1, min(p, 1), 0.0) for c, n, p, _ in rows]
    one, two = (as_dict(W.fit_logistic_weights(spark.createDataFrame(r, SCHEMA))) for r in (rows, halves))
    assert one == pytest.approx(two, abs=1e-6)


def test_stopped_or_impossible_fits_are_errors(spark):
    df = spark.createDataFrame(patterns_of(3), SCHEMA)
    with pytest.raises(W.NotConverged):
        W.fit_logistic_weights(df, max_iter=2)
    for bad in ([(["a"], 3, 3, 1.0)], [([], 4, 2, 0.5)], []):
        with pytest.raises(ValueError):
            W.fit_logistic_weights(spark.createDataFrame(bad, SCHEMA))


def test_features_without_a_driver_vocabulary(spark):
    rows = [(["b", "a"], 3, 1, 1 / 3), ([], 2, 1, 0.5), (["zz", "c"], 5, 0, 0.0), (["a", "b", "c"], 1, 1, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = W.code_index(df.where("NOT array_contains(combo, 'zz') OR n_pos > 0"))
    got = {tuple(r.combo): r.indices for r in W.feature_rows(df, index).collect()}
    assert got == {("b", "a"): [0, 1], (): [], ("zz", "c"): [2], ("a", "b", "c"): [0, 1, 2]}
    vectors = W.sparse_rows(W.feature_rows(df, index), 3).collect()
    assert sorted((r.label, r.weight, r.features.size, tuple(r.features.indices)) for r in vectors) == [
        (0.0, 1.0, 3, ()), (0.0, 2.0, 3, (0, 1)), (0.0, 5.0, 3, (2,)), (1.0, 1.0, 3, ()), (1.0, 1.0, 3, (0, 1)), (1.0, 1.0, 3, (0, 1, 2)),
    ]


def test_scores_by_hand_and_stored_model(spark, tmp_path):
    weights = spark.createDataFrame([(None, -1.0), ("a", 2.0), ("b", 0.5)], "code string, weight double")
    W.write_weights(weights, str(tmp_path / "model"))
    back = W.read_weights(spark, str(tmp_path / "model"))
    rows = [(["a", "b"], 3, 1, 1 / 3), (["a", "unknown"], 2, 1, 0.5), ([], 4, 1, 0.25), (["a", "b"], 1, 1, 1.0)]
    got = sorted((tuple(r.combo), r.n, r.risk_predicted) for r in W.score_patterns(spark.createDataFrame(rows, SCHEMA), back).collect())
    s = lambda z: 1 / (1 + math.exp(-z))
    assert got == [((), 4, pytest.approx(s(-1))), (("a", "b"), 1, pytest.approx(s(1.5))), (("a", "b"), 3, pytest.approx(s(1.5))), (("a", "unknown"), 2, pytest.approx(s(1)))]


def test_new_episodes_are_aligned(spark):
    weights = spark.createDataFrame([("a", 1.0)], "code string, weight double")
    rows = [(1, 1, 1, ["a", "x"], 2), (1, 2, 0, ["a", "x"], 2), (2, 3, 1, ["a"], 1), (2, 4, 0, ["y"], 1)]
    eps = spark.createDataFrame(rows, "subject_id long, episode_id long, outcome int, combo array<string>, n_codes int")
    got = sorted((tuple(r.combo), r.n, r.risk_true, round(r.risk_predicted, 6)) for r in score_episodes(eps, weights).collect())
    assert got == [((), 1, 0.0, 0.5), (("a",), 1, 1.0, 0.731059), (("a",), 2, 0.5, 0.731059)]


def test_fold_losses(spark):
    rows = patterns_of(7, count=60)
    df = spark.createDataFrame(rows, SCHEMA)
    from polyrisk.operators.sampling import kfold_assign_exact

    fold = {tuple(r.combo): r.fold for r in kfold_assign_exact(df, 2, 9).collect()}
    got = {r.fold: (r.n, r.loss) for r in fold_losses(df, 2, 9).collect()}
    for k in (0, 1):
        w = newton([r for r in rows if fold[tuple(r[0])] != k])
        held = [r for r in rows if fold[tuple(r[0])] == k]
        p = [1 / (1 + math.exp(-(w[0] + sum(w[1 + int(c[1:])] for c in combo)))) for combo, *_ in held]
        total = -sum(pos * math.log(q) + (n - pos) * math.log(1 - q) for (_, n, pos, _), q in zip(held, p))
        assert got[k] == (sum(r[1] for r in held), pytest.approx(total / sum(r[1] for r in held), rel=1e-6))
