"""Hyper-parameter search with group K-fold validation.

Trials are drawn by a seeded random search: ``trial_table`` is a Spark
DataFrame built from ``spark.range`` and hash expressions (reproducible, no
driver randomness).  All trials x folds are trained together, one pass over
the patterns per epoch; a model retires when its epoch budget ends.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyrisk.functions import hash_unit
from polyrisk.functions.expr import HASH_SPACE
from polyrisk.ml.train import FitResult, ModelSpec, cv_objective, fit_models

# Fixed values of the reference's search space (must match for equal trials).
EPOCH_CHOICES = (100, 500, 1000, 2000, 5000, 10000)
ACTIVATION_CHOICES = ("RELU", "LRELU")
LAYER_CHOICES = (1, 2)
HIDDEN_CHOICES = (100, 200, 300, 400, 500)
LEARNING_RATE_RANGE = (1e-5, 1e-2)          # log-uniform
PENALTY_LEARNING_RATE_RANGE = (1e-4, 1e-1)  # log-uniform, penalty modes only

# The penalty variants train exactly like their plain counterparts: in the
# reference the penalty never enters the loss that is differentiated, so its
# optimiser has no gradient.  Their trials still carry the extra
# sampled learning rate.
MODELS = ("network", "network_penalty", "logistic", "logistic_penalty")


def _uniform(seed: int, name: str):
    key = F.concat(F.col("trial_id").cast("string"), F.lit(f"|{name}"))
    return hash_unit(seed, key) / F.lit(HASH_SPACE)


def _choice(seed: int, name: str, values):
    arr = F.array(*[F.lit(v) for v in values])
    pos = (F.floor(_uniform(seed, name) * len(values)) + 1).cast("int")
    return F.element_at(arr, pos)


def _log_uniform(seed: int, name: str, lo: float, hi: float):
    return F.exp(F.lit(math.log(lo)) + _uniform(seed, name) * F.lit(math.log(hi) - math.log(lo)))


def trial_table(
    spark: SparkSession,
    n_trials: int,
    seed: int = 40,
    model: str = "network",
    epoch_choices=EPOCH_CHOICES,
    with_penalty: bool = False,
) -> DataFrame:
    """One row per trial: trial_id, epoch, activation, layers, hidden_dim_1,
    hidden_dim_2 (NULL unless 2 layers), learning_rate[, learning_rate_penalty]."""
    t = spark.range(n_trials).select(F.col("id").cast("int").alias("trial_id"))
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    with_penalty = with_penalty or model.endswith("_penalty")
    cols = [F.col("trial_id"), _choice(seed, "epoch", epoch_choices).alias("epoch")]
    if model.startswith("network"):
        layers = _choice(seed, "layers", LAYER_CHOICES)
        cols += [
            _choice(seed, "activation", ACTIVATION_CHOICES).alias("activation"),
            layers.alias("layers"),
            _choice(seed, "hidden_dim_1", HIDDEN_CHOICES).alias("hidden_dim_1"),
            F.when(layers == 2, _choice(seed, "hidden_dim_2", HIDDEN_CHOICES)).alias("hidden_dim_2"),
        ]
    else:
        cols += [
            F.lit("RELU").alias("activation"),
            F.lit(0).alias("layers"),
            F.lit(None).cast("int").alias("hidden_dim_1"),
            F.lit(None).cast("int").alias("hidden_dim_2"),
        ]
    cols.append(_log_uniform(seed, "learning_rate", *LEARNING_RATE_RANGE).alias("learning_rate"))
    if with_penalty:
        cols.append(_log_uniform(seed, "learning_rate_penalty", *PENALTY_LEARNING_RATE_RANGE).alias("learning_rate_penalty"))
    return t.select(*cols)


def spec_from_trial(row, seed: int, fold: int | None, dtype: str = "float64") -> ModelSpec:
    hidden = ()
    if row["layers"] >= 1:
        hidden = (int(row["hidden_dim_1"]),)
    if row["layers"] == 2:
        hidden = hidden + (int(row["hidden_dim_2"]),)
    return ModelSpec(
        hidden=hidden,
        activation=row["activation"],
        learning_rate=float(row["learning_rate"]),
        epochs=int(row["epoch"]),
        seed=seed + int(row["trial_id"]),
        fold=fold,
        tag=int(row["trial_id"]),
        dtype=dtype,
    )


def run_search(trials: DataFrame, blocks, n_features: int, k: int, seed: int = 40,
               max_models_per_pass: int = 12,
               dtype: str = "float32") -> tuple[DataFrame, dict[int, list[FitResult]]]:
    """Cross-validated objective per trial; returns the trial table with
    ``value`` (sorted by value, then trial_id) and the fold results.

    The trial table is small (one row per trial) and is read on the driver to
    configure the models; models are trained in bundles of at most
    ``max_models_per_pass`` so that broadcast weights stay bounded.  Search
    models run in float32 (the reference's tensor type; about 1.6x faster
    passes and half the gradient traffic), final fits default to float64.
    """
    rows = [r.asDict() for r in trials.orderBy("trial_id").collect()]
    specs = [spec_from_trial(r, seed, fold, dtype) for r in rows for fold in range(k)]
    # bundle models of similar epoch budgets: a bundle costs max(epochs) + 1 passes
    specs.sort(key=lambda sp: (sp.epochs, sp.tag, sp.fold))
    results: list[FitResult] = []
    for start in range(0, len(specs), max_models_per_pass):
        results.extend(fit_models(blocks, n_features, specs[start : start + max_models_per_pass]))
    by_trial: dict[int, list[FitResult]] = {}
    for res in results:
        by_trial.setdefault(res.spec.tag, []).append(res)
    values = [(tid, cv_objective(folds)) for tid, folds in by_trial.items()]
    spark = trials.sparkSession
    scored = spark.createDataFrame(values, "trial_id int, value double")
    table = trials.join(scored, "trial_id").orderBy("value", "trial_id")
    return table, by_trial


def best_trial(table: DataFrame) -> dict:
    """Top-1 trial by objective (ties by trial_id): F6."""
    return table.orderBy("value", "trial_id").limit(1).collect()[0].asDict()
