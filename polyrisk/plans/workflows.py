"""The reference's four entry points as end-to-end Spark workflows.

Each function takes canonical inputs (exposures or episodes DataFrames) and
an output folder (a shared path on a cluster) and writes the tables the
reference wrote, as Parquet (or CSV where it wrote CSV):

    run_statistics       cleaning + per-code statistics + screen + exclusion
    run_training         combination risk -> group sample -> search -> final
                         fit -> losses, weights, seen-combination scores
    run_scoring          stored model -> scores for another dataset
    run_sampling_study   sampling error per fraction, densities, box stats
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame

from polyrisk import sinks
from polyrisk.ml import search as SR
from polyrisk.ml import train as TR
from polyrisk.operators import describe as D
from polyrisk.operators import histograms as H
from polyrisk.operators import sampling as S
from polyrisk.operators.episodes import build_episodes, dataset_profile
from polyrisk.operators.vocab import align_lenient, align_strict
from polyrisk.plans.screening import run_screening
from polyrisk.session import cut_lineage


def _path(root: str, name: str) -> str:
    return os.path.join(root, name)


def run_statistics(exposure_rows: DataFrame, out_dir: str, thres: int = 0, vocab: DataFrame | None = None,
                   reference_names: bool = False) -> dict:
    """Entry 1: distinct exposures -> episodes (multi-hot) -> statistics and
    screen -> two-step exclusion -> cleaned episodes; plus the plot tables.

    With ``vocab`` the episodes are first aligned strictly (a listed code
    that never occurs is an error, as in the reference).  With
    ``reference_names`` the CSV outputs use the reference's column names.
    """
    names = sinks.with_reference_names if reference_names else (lambda df: df)
    episodes = build_episodes(exposure_rows)
    if vocab is not None:
        episodes = align_strict(episodes, vocab)
    episodes = cut_lineage(episodes)
    sinks.write_episodes(episodes, _path(out_dir, "episodes"))
    res = run_screening(episodes, thres)
    sinks.write_csv(dataset_profile(exposure_rows, episodes), _path(out_dir, "profile"))
    sinks.write_csv(names(res.code_stats), _path(out_dir, "code_probabilities"))
    sinks.write_screens(names(res.screen), _path(out_dir, "screens"))
    sinks.write_csv(names(res.excluded_counts()), _path(out_dir, "excluded_counts"))
    sinks.write_episodes(res.cleaned, _path(out_dir, "cleaned"))
    sinks.write_csv(D.ranked_probability_curve(res.code_stats), _path(out_dir, "probability_curve"))
    sinks.write_csv(D.ranked_count_curve(res.code_stats), _path(out_dir, "count_curve"))
    sinks.write_csv(H.co_exposure_histogram(res.cleaned), _path(out_dir, "co_exposure"))
    sinks.write_csv(H.record_size_histogram(res.cleaned, include_outcome=True), _path(out_dir, "record_sizes"))
    kept_sizes = H.codes_per_episode(episodes, res.kept())
    sinks.write_csv(H.size_by_class(kept_sizes), _path(out_dir, "codes_per_episode_by_class"))
    return {"episodes": _path(out_dir, "episodes"), "cleaned": _path(out_dir, "cleaned")}


@dataclass
class TrainingRun:
    trials: DataFrame
    best: dict
    result: TR.FitResult
    vocab: list[str]


def run_training(
    episodes: DataFrame,
    vocab: list[str],
    out_dir: str,
    n_trials: int = 20,
    n_splits: int = 3,
    fraction: float = 1.0,
    seed: int = 40,
    model: str = "network",
    epoch_choices=SR.EPOCH_CHOICES,
    exact_sample: bool = True,
) -> TrainingRun:
    """Entry 2: align to ``vocab``, sample combinations, search with group K-fold, refit the best
    configuration on all sampled combinations, write trials, best
    parameters, loss curve, weights and the seen-combination scores.

    ``exact_sample`` takes exactly round(fraction * m) of the m
    aligned combinations (as the reference does); otherwise each combination is
    kept with probability ``fraction`` (hash threshold, no extra job)."""
    spark = episodes.sparkSession
    aligned = align_lenient(episodes, spark.createDataFrame([(c,) for c in vocab], "code string"))
    if exact_sample:
        sampled = S.group_sample_exact(aligned, fraction, seed)
    else:
        sampled = S.group_sample(aligned, fraction, seed)
    patterns, blocks = TR.prepare(sampled, vocab, k=n_splits, seed=seed)
    try:
        trials = SR.trial_table(spark, n_trials, seed, model=model, epoch_choices=epoch_choices)
        table, _ = SR.run_search(trials, blocks, len(vocab), n_splits, seed)
        sinks.write_csv(table, _path(out_dir, "sorted_trials"))
        best = SR.best_trial(table)
        # top-1 trial by objective (F6): a one-row table
        sinks.write_json(table.orderBy("value", "trial_id").limit(1), _path(out_dir, "best_params"))
        spec = SR.spec_from_trial(best, seed, fold=None)
        result = TR.fit_models(blocks, len(vocab), [spec])[0]
    finally:
        blocks.unpersist()
    losses = spark.createDataFrame(
        [(i + 1, v) for i, v in enumerate(result.train_loss)], "epoch int, loss_train double"
    )
    sinks.write_csv(losses, _path(out_dir, "train_results"))
    TR.save_weights(spark, result.params, _path(out_dir, "model"))
    scores = TR.score(patterns, result.params, spec.activation, len(vocab))
    sinks.write_csv(D.calibration_table(scores), _path(out_dir, "seen_probabilities"))
    return TrainingRun(table, best, result, vocab)


def run_scoring(episodes: DataFrame, model_dir: str, activation: str, vocab: list[str], out_dir: str) -> DataFrame:
    """Entry 3: load a stored model and score every (combination, risk) of
    another dataset (aligned to the model's vocabulary)."""
    spark = episodes.sparkSession
    params = TR.load_weights(spark, model_dir)
    scores = TR.score(TR.training_patterns(episodes, vocab), params, activation, len(vocab))
    sinks.write_csv(D.calibration_table(scores), _path(out_dir, "new_probabilities"))
    return scores


def run_sampling_study(episodes: DataFrame, out_dir: str, fractions=(0.25, 0.5, 0.75, 1.0), seed: int = 42) -> None:
    """Entry 4: frequency filter, risk error on samples of fixed size, densities, box statistics."""
    errors = cut_lineage(S.sampling_error(episodes, fractions, seed, exact=True))
    sinks.write_csv(errors, _path(out_dir, "errors"))
    sinks.write_csv(S.errors_wide(errors, fractions), _path(out_dir, "errors_wide"))
    sinks.write_csv(D.kernel_density(errors, "error", "fraction"), _path(out_dir, "densities"))
    sinks.write_csv(D.box_stats(errors, "error", "fraction"), _path(out_dir, "box"))
