"""Scores of whole episode tables and fold losses by weight tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrisk.functions import bce_terms
from polyrisk.ml import weights as W
from polyrisk.operators import patterns as PT
from polyrisk.operators import sampling as S
from polyrisk.operators import vocab as V


def score_episodes(episodes: DataFrame, weights: DataFrame) -> DataFrame:
    """(combo, n, risk_true, risk_predicted) of another dataset under a stored model: K14.

    Combination risk comes from the new data, codes the model does not know are
    dropped (lenient alignment), and each distinct (combination, risk) that is
    left is scored.
    """
    risk_rows = PT.attach_risk(episodes, PT.combo_patterns(episodes))
    aligned = V.align_lenient(risk_rows, weights.where("code IS NOT NULL").select("code"))
    return W.score_patterns(PT.risk_frequency(aligned), weights)


def fold_losses(patterns: DataFrame, k: int, seed: int, max_iter: int = W.MAX_ITER) -> DataFrame:
    """(fold, n, loss): mean held-out loss of the logistic model, by fold of whole combinations.

    The mean of ``loss`` over the folds is the cross-validated objective.
    """
    folds = S.kfold_assign_exact(patterns, k, seed)
    out = None
    for fold in range(k):
        weights = W.fit_logistic_weights(folds.where(F.col("fold") != fold), max_iter=max_iter)
        held = W.linear_scores(folds.where(F.col("fold") == fold), weights)
        loss = held.agg(F.lit(fold).alias("fold"), F.sum("n").alias("n"), (F.sum(bce_terms("n", "n_pos", "risk_predicted")) / F.sum("n")).alias("loss"))
        out = loss if out is None else out.unionByName(loss)
    return out
