"""Training and scoring entry points (the reference's train / test scripts).

Registered model queries (no SQL twin; checked by row counts and unit tests):

    logistic_scores     fitted logistic model -> predicted risk per pattern
    logistic_holdout_scores, logistic_fold_losses   the same on held-out combinations
    network_scores      network fitted with the best published configuration
    network_loss_curve  its per-epoch training loss
    calibration_table   true vs predicted risk of the logistic model with the colour-scale value

``run_cv_search`` (the full 20-trial search) and its running best are entry
points only: at their full size they are too long for a registered query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from polyrisk.functions import combo_key
from polyrisk.ml import search as SR
from polyrisk.ml import train as TR
from polyrisk.ml import weights as W
from polyrisk.operators import describe as D
from polyrisk.operators.episodes import exposures_of
from polyrisk.operators.patterns import combo_patterns
from polyrisk.operators.sampling import group_sample
from polyrisk.plans import params as P
from polyrisk.plans.catalog import _episodes
from polyrisk.plans.scoring import fold_losses, score_episodes
from polyrisk.session import materialise

# The best published configuration of the reference (one of its two runs).
BEST_NETWORK = {"epoch": 500, "activation": "RELU", "layers": 1, "hidden_dim_1": 100,
                "learning_rate": 0.0026933629243587895}

TRAIN_FRACTION = 1.0      # the reference trains on every sampled combination (frac=1)
INIT_SEED = 42
CV_TRIALS = 20


@dataclass
class TrainedNetwork:
    patterns: DataFrame
    vocab: list[str]
    result: TR.FitResult


_CACHE: dict = {}


def observed_vocabulary(episodes: DataFrame) -> list[str]:
    """All observed codes in code order: the model's features, one weight or more each."""
    codes = exposures_of(episodes).select("code").distinct()
    return [r.code for r in codes.orderBy("code").collect()]


def train_network(episodes: DataFrame, config: dict = BEST_NETWORK, fraction: float = TRAIN_FRACTION,
                  seed: int = P.SAMPLE_SEED, epochs: int | None = None) -> TrainedNetwork:
    """Sample combinations, collapse to patterns, fit one network: K12 (+ J1)."""
    vocab = observed_vocabulary(episodes)
    sampled = group_sample(episodes, fraction, seed)
    patterns, blocks = TR.prepare(sampled, vocab, k=None)
    hidden = tuple(int(config[f"hidden_dim_{i}"]) for i in range(1, int(config["layers"]) + 1))
    spec = TR.ModelSpec(hidden=hidden, activation=config["activation"],
                        learning_rate=float(config["learning_rate"]),
                        epochs=int(epochs or config["epoch"]), seed=INIT_SEED)
    try:
        result = TR.fit_models(blocks, len(vocab), [spec])[0]
    finally:
        blocks.unpersist()
    return TrainedNetwork(patterns, vocab, result)


def _network(spark: SparkSession, sf_dir: str) -> TrainedNetwork:
    key = ("network", spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = train_network(_episodes(spark, sf_dir))
    return _CACHE[key]


def q_network_scores(spark, sf_dir):
    net = _network(spark, sf_dir)
    return TR.score(net.patterns, net.result.params, net.result.spec.activation, len(net.vocab))


def q_network_loss_curve(spark, sf_dir):
    net = _network(spark, sf_dir)
    rows = [(i + 1, v) for i, v in enumerate(net.result.train_loss)]
    return spark.createDataFrame(rows, "epoch int, loss_train double")


def q_calibration_table(spark, sf_dir):
    return D.calibration_table(q_logistic_scores(spark, sf_dir))


def q_logistic_scores(spark, sf_dir):
    """The fitted logistic model on the combinations it has seen."""
    patterns = materialise(combo_patterns(_episodes(spark, sf_dir)), "patterns")
    scores = W.score_patterns(patterns, W.fit_logistic_weights(patterns))
    return scores.withColumn("combo", combo_key("combo"))


def score_new_dataset(episodes: DataFrame, params, activation: str, vocab: list[str]) -> DataFrame:
    """Score another dataset with a stored model: K14.

    Combination risk is computed on the new data, codes are aligned to the
    model's vocabulary (unknown codes dropped), and every distinct
    (combination, risk) gets the model's prediction.
    """
    return TR.score(TR.training_patterns(episodes, vocab), params, activation, len(vocab))


def q_logistic_holdout_scores(spark, sf_dir):
    """Fit on exactly 40% of the combinations, score the unseen ones (J5 + K14)."""
    from polyrisk.operators.sampling import group_sample_exact, holdout_unseen_exact

    ep = _episodes(spark, sf_dir)
    weights = W.fit_logistic_weights(combo_patterns(group_sample_exact(ep, P.SAMPLE_FRACTION, P.SAMPLE_SEED)))
    scores = score_episodes(holdout_unseen_exact(ep, P.SAMPLE_FRACTION, P.SAMPLE_SEED), weights)
    return scores.withColumn("combo", combo_key("combo"))


def q_logistic_fold_losses(spark, sf_dir):
    """Held-out loss of the logistic model in each fold."""
    return fold_losses(combo_patterns(_episodes(spark, sf_dir)), P.N_SPLITS, P.SAMPLE_SEED)


def run_cv_search(episodes: DataFrame, n_trials: int = CV_TRIALS, k: int = P.N_SPLITS,
                  seed: int = P.SAMPLE_SEED, epoch_choices=SR.EPOCH_CHOICES):
    vocab = observed_vocabulary(episodes)
    _, blocks = TR.prepare(episodes, vocab, k=k, seed=seed)
    try:
        trials = SR.trial_table(episodes.sparkSession, n_trials, seed, epoch_choices=epoch_choices)
        table, _ = SR.run_search(trials, blocks, len(vocab), k, seed)
    finally:
        blocks.unpersist()
    return table


MODEL_QUERIES = {
    "logistic_scores": q_logistic_scores,
    "logistic_holdout_scores": q_logistic_holdout_scores,
    "logistic_fold_losses": q_logistic_fold_losses,
    "network_scores": q_network_scores,
    "network_loss_curve": q_network_loss_curve,
    "calibration_table": q_calibration_table,
}
