import math

import numpy as np
import pytest

from polyrisk.ml import kernels as K
from polyrisk.ml import train as TR
from polyrisk.ml import logistic as LG
from polyrisk.ml import search as SR
from polyrisk.operators.episodes import non_empty

VOCAB = ["A", "B", "C", "D"]


def _golden_blocks(golden_episodes, k=None):
    pt = TR.assign_folds(TR.training_patterns(non_empty(golden_episodes), VOCAB), k, 40)
    return pt, TR.build_blocks(pt, len(VOCAB))


def test_logistic_gradient_at_zero(golden_episodes):
    """FIXTURES §4: loss ln 2, mean gradient A +1/16, B -1/16, C +1/16, D -1/16, bias 0."""
    _, blocks = _golden_blocks(golden_episodes)
    zero = [(np.zeros((1, 4)), np.zeros(1))]
    acc = TR.run_pass(blocks, [{"params": zero, "activation": "RELU", "fold": -1, "grad": True}])[0]
    assert acc["train_n"] == 8
    assert acc["train_hard"] / acc["train_n"] == pytest.approx(math.log(2))
    gw, gb = acc["grads"][0]
    assert np.allclose(gw[0] / 8, [0.0625, -0.0625, 0.0625, -0.0625])
    assert gb[0] == pytest.approx(0.0)


def _numeric_grad(params, block, activation, eps=1e-6):
    def loss(ps):
        out = K.block_pass(block, [{"params": ps, "activation": activation, "fold": -1, "grad": False}])[0]
        return out["train_hard"]

    grads = []
    for li, (w, b) in enumerate(params):
        layer = []
        for arr_i, arr in enumerate((w, b)):
            g = np.zeros_like(arr)
            for idx in np.ndindex(arr.shape):
                def shifted(delta):
                    ps = [(w2.copy(), b2.copy()) for w2, b2 in params]
                    ps[li][arr_i][idx] += delta
                    return ps
                g[idx] = (loss(shifted(eps)) - loss(shifted(-eps))) / (2 * eps)
            layer.append(g)
        grads.append(layer)
    return grads


@pytest.mark.parametrize("hidden", [(), (5,), (4, 3)])
@pytest.mark.parametrize("activation", ["RELU", "LRELU"])
def test_backward_matches_finite_differences(hidden, activation):
    rng = np.random.default_rng(5)
    rows = [(sorted(rng.choice(6, size=rng.integers(1, 4), replace=False).tolist()), float(rng.integers(1, 5)), 0.0, 0.0, None) for _ in range(30)]
    rows = [(ix, n, float(rng.integers(0, int(n) + 1)), 0.0, f) for ix, n, _, _, f in rows]
    block = K.rows_to_block(rows, 6)
    params = K.init_params(6, hidden, seed=3)
    params = [(w, b + 0.05) for w, b in params]  # move ReLU kinks away from 0
    out = K.block_pass(block, [{"params": params, "activation": activation, "fold": -1, "grad": True}])[0]
    numeric = _numeric_grad(params, block, activation)
    for (gw, gb), (nw, nb) in zip(out["grads"], numeric):
        assert np.allclose(gw, nw, rtol=1e-4, atol=1e-6)
        assert np.allclose(gb, nb, rtol=1e-4, atol=1e-6)


def test_adam_step_matches_formula():
    params = [(np.array([[1.0, -2.0]]), np.array([0.5]))]
    grads = [(np.array([[0.1, -0.3]]), np.array([0.2]))]
    opt = K.Adam(params, lr=0.01)
    new = opt.step(params, grads)
    # first step: m_hat = g, v_hat = g^2 -> update = lr * g / (|g| + eps)
    expected_w = params[0][0] - 0.01 * grads[0][0] / (np.abs(grads[0][0]) + 1e-8)
    assert np.allclose(new[0][0], expected_w)
    second = opt.step(new, grads)
    assert np.allclose(second[0][0], expected_w - 0.01 * grads[0][0] / (np.abs(grads[0][0]) + 1e-8))


def test_patterns_gradient_equals_raw_rows(spark, golden_episodes):
    """Gradient on patterns = gradient on raw episodes."""
    _, blocks = _golden_blocks(golden_episodes)
    params = K.init_params(4, (3,), seed=11)
    spec = {"params": params, "activation": "LRELU", "fold": -1, "grad": True}
    collapsed = TR.run_pass(blocks, [spec])[0]
    raw_rows = []
    for r in non_empty(golden_episodes).collect():
        raw_rows.append(([VOCAB.index(c) for c in r.combo], 1.0, float(r.outcome), float(r.outcome), None))
    raw = K.block_pass(K.rows_to_block(raw_rows, 4), [spec])[0]
    for (a, b), (c, d) in zip(collapsed["grads"], raw["grads"]):
        assert np.allclose(a, c) and np.allclose(b, d)
    assert collapsed["train_hard"] == pytest.approx(raw["train_hard"])


def test_soft_and_hard_loss_agree_on_whole_groups(golden_episodes):
    """BCE against outcome = BCE against combination risk for whole groups."""
    _, blocks = _golden_blocks(golden_episodes)
    spec = {"params": K.init_params(4, (3,), seed=2), "activation": "RELU", "fold": -1, "grad": False}
    acc = TR.run_pass(blocks, [spec])[0]
    assert acc["train_soft"] == pytest.approx(acc["train_hard"])


def test_fit_decreases_loss_and_respects_entropy_floor(spark):
    """Training loss never goes below the per-pattern entropy floor."""
    from polyrisk.sources import tables
    from polyrisk.plans.modeling import observed_vocabulary

    eps = tables.episodes(spark, "/root/testdata/sf0.001", "type")
    vocab = observed_vocabulary(eps)
    pt, blocks = TR.prepare(eps, vocab)
    res = TR.fit_models(blocks, len(vocab), [TR.ModelSpec(hidden=(8,), learning_rate=0.05, epochs=30)])[0]
    floor = 0.0
    total = 0.0
    for r in pt.collect():
        for y, w in ((1.0, r.n_pos), (0.0, r.n - r.n_pos)):
            p = r.risk if y == 1.0 else 1.0 - r.risk
            floor -= w * (math.log(p) if p > 0 else 0.0)
        total += r.n
    floor /= total
    assert res.train_loss[-1] < res.train_loss[0]
    assert min(res.train_loss) >= floor - 1e-9
    blocks.unpersist()


def test_cv_folds_validate_on_held_out_only(spark, golden_episodes):
    pt, blocks = _golden_blocks(golden_episodes, k=2)
    specs = [TR.ModelSpec(hidden=(2,), epochs=3, fold=f, seed=1) for f in range(2)]
    res = TR.fit_models(blocks, 4, specs)
    folds = {r.fold: r["sum(n)"] for r in pt.groupBy("fold").sum("n").collect()}
    for r in res:
        assert len(r.val_loss) == 3 and len(r.train_loss) == 3
    assert sum(folds.values()) == 8


def test_trial_table_space(spark):
    trials = SR.trial_table(spark, 50, seed=40).collect()
    assert len(trials) == 50
    for t in trials:
        assert t.epoch in SR.EPOCH_CHOICES and t.activation in SR.ACTIVATION_CHOICES
        assert 1e-5 <= t.learning_rate <= 1e-2
        assert (t.hidden_dim_2 is None) == (t.layers == 1)
    again = SR.trial_table(spark, 50, seed=40).collect()
    assert trials == again


def test_mllib_logistic_collapsed_equals_raw(spark):
    """Weighted two-rows-per-pattern fit = fit on raw episodes (non-separable data)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.sql import functions as F

    from polyrisk.plans.modeling import observed_vocabulary
    from polyrisk.sources import tables

    eps = tables.episodes(spark, "/root/testdata/sf0.001", "brand")
    vocab = observed_vocabulary(eps)
    pt = TR.training_patterns(eps, vocab)
    feats, model = LG.fit_logistic(pt, vocab, max_iter=200)
    raw = eps.select("combo", F.col("outcome").cast("double").alias("label"), F.lit(1.0).alias("weight"))
    raw_model = LogisticRegression(
        weightCol="weight", regParam=0.0, standardization=False, maxIter=200, tol=1e-8
    ).fit(feats.transform(raw))
    assert np.allclose(model.coefficients.toArray(), raw_model.coefficients.toArray(), atol=1e-5)
    assert model.intercept == pytest.approx(raw_model.intercept, abs=1e-5)


def test_weights_roundtrip_and_scoring(spark, golden_episodes):
    params = K.init_params(4, (3,), seed=9)
    back = TR.params_from_table(TR.weights_table(spark, params))
    for (w1, b1), (w2, b2) in zip(params, back):
        assert np.array_equal(w1, w2) and np.array_equal(b1, b2)
    pt = TR.training_patterns(non_empty(golden_episodes), VOCAB)
    scored = {r.combo: r.risk_predicted for r in TR.score(pt, params, "RELU", 4).collect()}
    expect = K.predict_indices(params, "RELU", [[0, 1]], 4)[0]
    assert scored["A|B"] == pytest.approx(expect)


def test_keep_best_returns_lowest_loss_weights(spark, golden_episodes):
    _, blocks = _golden_blocks(golden_episodes)
    # a learning rate this large oscillates, so the last weights are not the best
    spec = TR.ModelSpec(hidden=(), learning_rate=5.0, epochs=6, seed=3)
    best = TR.fit_models(blocks, 4, [spec], keep="best")[0]
    acc = TR.run_pass(blocks, [{"params": best.params, "activation": "RELU", "fold": -1, "grad": False}])[0]
    assert acc["train_soft"] / acc["train_n"] == pytest.approx(min(best.train_loss))


def test_save_load_and_score_new_dataset(spark, golden_episodes, tmp_path):
    from polyrisk.plans.modeling import score_new_dataset

    params = K.init_params(4, (3,), seed=4)
    path = str(tmp_path / "weights")
    TR.save_weights(spark, params, path)
    loaded = TR.load_weights(spark, path)
    scored = {r.combo: r.risk_predicted for r in score_new_dataset(non_empty(golden_episodes), loaded, "LRELU", VOCAB).collect()}
    assert scored["C"] == pytest.approx(K.predict_indices(params, "LRELU", [[2]], 4)[0])
    assert set(scored) == {"A", "A|B", "B", "C", "D"}


def test_penalty_models_sample_extra_learning_rate(spark):
    t = SR.trial_table(spark, 5, seed=1, model="logistic_penalty").collect()
    assert all(r.layers == 0 and 1e-4 <= r.learning_rate_penalty <= 1e-1 for r in t)
    with pytest.raises(ValueError):
        SR.trial_table(spark, 1, model="forest")


def test_penalised_bce_equals_bce_without_floor(spark):
    from pyspark.sql import functions as F

    from polyrisk.functions import bce_terms, penalised_bce_terms

    df = spark.createDataFrame([(10, 3, 0.4), (5, 5, 0.9)], "n long, n_pos long, p double")
    row = df.agg(F.sum(bce_terms("n", "n_pos", "p")).alias("a"), F.sum(penalised_bce_terms("n", "n_pos", "p")).alias("b")).first()
    assert row.a == pytest.approx(row.b, rel=1e-5)


def test_distributed_fit_matches_single_process_adam_on_raw_rows(spark):
    """K8: Spark passes over collapsed patterns reproduce a plain full-batch
    Adam loop over raw episode rows (same initial weights)."""
    from polyrisk.plans.modeling import observed_vocabulary
    from polyrisk.sources import tables

    eps = tables.episodes(spark, "/root/testdata/sf0.001", "type")
    vocab = observed_vocabulary(eps)
    pt, blocks = TR.prepare(eps, vocab)
    init = K.init_params(len(vocab), (6,), seed=21)
    spec = TR.ModelSpec(hidden=(6,), activation="LRELU", learning_rate=0.01, epochs=8)
    res = TR.fit_models(blocks, len(vocab), [spec], init=[init])[0]
    blocks.unpersist()

    rows = eps.select("combo", "outcome").collect()
    x = np.zeros((len(rows), len(vocab)))
    for i, r in enumerate(rows):
        for c in r.combo:
            x[i, vocab.index(c)] = 1.0
    y = np.array([float(r.outcome) for r in rows])
    params, opt, losses = init, K.Adam(init, 0.01), []
    for _ in range(8):
        p, cache = K.forward(params, x, "LRELU")
        losses.append(K.bce_sum(np.ones_like(y), y, p) / len(y))
        pq = p * (1 - p)
        grads = K.backward(params, cache, (p - y) * pq / np.maximum(pq, K.CLAMP_EPS), "LRELU")
        params = opt.step(params, [(gw / len(y), gb / len(y)) for gw, gb in grads])
    assert np.allclose(res.train_loss_hard, losses, rtol=1e-9, atol=1e-12)
    for (w1, b1), (w2, b2) in zip(res.params, params):
        assert np.allclose(w1, w2, rtol=1e-8, atol=1e-10) and np.allclose(b1, b2, rtol=1e-8, atol=1e-10)


def test_float32_training_tracks_float64(spark, golden_episodes):
    from polyrisk.plans.modeling import observed_vocabulary
    from polyrisk.sources import tables

    eps = tables.episodes(spark, "/root/testdata/sf0.001", "brand")
    vocab = observed_vocabulary(eps)
    _, blocks = TR.prepare(eps, vocab)
    init = K.init_params(len(vocab), (16,), seed=5)
    specs = [TR.ModelSpec(hidden=(16,), learning_rate=0.01, epochs=10, dtype=d) for d in ("float64", "float32")]
    r64, r32 = TR.fit_models(blocks, len(vocab), specs, init=[init, init])
    blocks.unpersist()
    assert np.allclose(r64.train_loss, r32.train_loss, rtol=1e-4)
    assert np.allclose(r64.params[0][0], r32.params[0][0], atol=1e-3)


def test_partitions_are_merged_by_tasks_not_by_the_driver(spark, monkeypatch):
    """However many partitions there are, the driver receives one set of sums a pass."""
    import os

    driver, merge = os.getpid(), K.merge_results

    def merged_in_a_task(a, b):
        assert os.getpid() != driver
        return merge(a, b)

    monkeypatch.setattr(K, "merge_results", merged_in_a_task)
    rng = np.random.default_rng(5)
    rows = [(sorted(rng.choice(4, 2, replace=False).tolist()), 3.0, float(i % 4), (i % 4) / 3, None) for i in range(40)]
    spec = {"params": K.init_params(4, (3,), seed=11), "activation": "RELU", "fold": -1, "grad": True}
    whole = K.block_pass(K.rows_to_block(rows, 4), [spec])[0]
    for parts, depth in ((1, 1), (10, 1), (10, 2)):
        blocks = spark.sparkContext.parallelize(range(10), parts).map(lambda i: K.rows_to_block(rows[4 * i : 4 * i + 4], 4))
        got = TR.run_pass(blocks, [spec], depth)[0]
        assert got["train_n"] == whole["train_n"] and got["train_hard"] == pytest.approx(whole["train_hard"])
        for (a, b), (c, d) in zip(got["grads"], whole["grads"]):
            assert np.allclose(a, c) and np.allclose(b, d)
