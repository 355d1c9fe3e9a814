"""Distributed full-batch training of risk models on collapsed patterns.

Plan of a training job:

1. ``training_patterns``: episodes -> combination risk on the full code set
   (S8) -> aligned to the vocabulary -> distinct (aligned codes, risk) with
   row and positive counts.  Two aggregations; the second runs on the
   already small pattern table.
2. The patterns are checkpointed to the cluster's checkpoint directory
   (lineage cut: a lost executor re-reads files, not the source tables) and
   turned into cached numpy blocks, one or more per partition.
3. Every epoch is one Spark job: the current weights of all bundled models
   (trials x folds) are broadcast, each task runs forward/backward for every
   model over its blocks, and per-model gradient and loss sums are merged by
   tasks into one set.  The driver receives that and holds the weights (both
   bounded by the architecture, not by the data) and applies the Adam step.

A model sees a pattern in training iff the pattern's fold differs from the
model's held-out fold, and in validation iff it is equal, so all folds of all
trials share one pass over the data.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrisk.functions import combo_key
from polyrisk.ml import kernels as K
from polyrisk.operators.patterns import combo_patterns
from polyrisk.operators.contingency import is_listed
from polyrisk.operators.sampling import combo_bucket, kfold_assign_exact
from polyrisk.session import cut_lineage

# Tasks receive the kernels by value: executors need numpy, not this package.
cloudpickle.register_pickle_by_value(K)

ROWS_PER_BLOCK = 65536


def training_patterns(episodes: DataFrame, vocab_codes: list[str]) -> DataFrame:
    """Distinct (aligned combination, risk) with counts and feature indices.

    Columns: combo ARRAY<STRING> (aligned), idx ARRAY<INT> (0-based vocabulary
    positions), risk, n, n_pos.
    """
    places = F.create_map(*(F.lit(x) for at, c in enumerate(vocab_codes) for x in (c, at)))
    full = combo_patterns(episodes)
    aligned = full.select(F.filter("combo", lambda c: is_listed(c, vocab_codes)).alias("combo"), "risk", "n", "n_pos")
    grouped = aligned.groupBy("combo", "risk").agg(
        F.sum("n").cast("bigint").alias("n"), F.sum("n_pos").cast("bigint").alias("n_pos")
    )
    idx = F.transform("combo", lambda c: F.element_at(places, c))
    return grouped.withColumn("idx", idx)


def assign_folds(patterns: DataFrame, k: int | None, seed: int, folds: str = "exact") -> DataFrame:
    """Group folds by aligned combination (every risk variant of it together).

    ``folds="exact"``: equal fold sizes as a shuffled K-fold split gives
    (``operators.sampling.kfold_assign_exact``); ``"hash"``: near-equal hash
    buckets, no extra job.
    """
    if not k:
        return patterns.withColumn("fold", F.lit(None).cast("int"))
    if folds == "exact":
        return kfold_assign_exact(patterns, k, seed)
    if folds == "hash":
        return patterns.withColumn("fold", F.pmod(combo_bucket(seed, "combo"), F.lit(k)).cast("int"))
    raise ValueError("folds must be 'exact' or 'hash'")


def build_blocks(patterns: DataFrame, n_features: int, rows_per_block: int = ROWS_PER_BLOCK):
    """Cached RDD of numpy pattern blocks (the per-partition imperative part)."""
    cols = patterns.select("idx", "n", "n_pos", "risk", "fold")

    def to_blocks(rows):
        buf = []
        for r in rows:
            buf.append((r[0], float(r[1]), float(r[2]), float(r[3]), r[4]))
            if len(buf) >= rows_per_block:
                yield K.rows_to_block(buf, n_features)
                buf = []
        if buf:
            yield K.rows_to_block(buf, n_features)

    return cols.rdd.mapPartitions(to_blocks).persist(StorageLevel.MEMORY_AND_DISK)


@dataclass
class ModelSpec:
    """One model to fit: architecture, optimiser settings and held-out fold."""

    hidden: tuple[int, ...] = ()
    activation: str = "RELU"
    learning_rate: float = 1e-3
    epochs: int = 100
    seed: int = 42
    fold: int | None = None
    tag: object = None
    # "float64" (default, exact) or "float32" (the reference's tensor type:
    # half the memory traffic in tasks and half the gradient traffic per epoch)
    dtype: str = "float64"


@dataclass
class FitResult:
    spec: ModelSpec
    params: list
    train_loss: list[float] = field(default_factory=list)       # soft target, before each update
    train_loss_hard: list[float] = field(default_factory=list)  # hard label, before each update
    val_loss: list[float] = field(default_factory=list)         # soft target, after each update


def run_pass(blocks, payload: list[dict], tree_depth: int = 1) -> list[dict]:
    """One Spark job: every model of ``payload`` over every block, summed.

    The payload (weights of the bundled models) is broadcast once per pass
    and destroyed afterwards.  The partitions' sums are merged by tasks, in
    ``tree_depth`` levels and in the order of the partitions, so the driver
    receives one set of sums a pass, however many partitions there are.
    """
    bc = blocks.context.broadcast(payload)
    left = blocks.getNumPartitions()
    width = max(2, math.ceil(left ** (1 / tree_depth)))

    def passed(at, part):
        sums = [K.block_pass(b, bc.value) for b in part]
        return [(at, reduce(K.merge_results, sums))] if sums else []

    def merged(group):
        return group[0], reduce(K.merge_results, [sums for _, sums in sorted(group[1], key=lambda one: one[0])])

    try:
        sums = blocks.mapPartitionsWithIndex(passed)
        while left > 1:
            left = math.ceil(left / width)
            sums = sums.map(lambda one: (one[0] // width, one)).groupByKey(left).map(merged)
        found = sums.values().collect()
    finally:
        bc.destroy()
    if not found:
        raise ValueError("no patterns to train on")
    return found[0]


def fit_models(blocks, n_features: int, specs: list[ModelSpec], init: list | None = None,
               tree_depth: int | None = None, keep: str = "last") -> list[FitResult]:
    """Train every spec together, one Spark job per epoch (plus one final
    validation pass).  ``init`` optionally injects starting weights.

    Partial sums are merged by one task for few partitions and in two levels
    beyond that; the driver receives one gradient set per model and epoch.

    ``keep="last"`` returns the weights after the final update (what the
    reference saves); ``keep="best"`` returns the weights that achieved the
    lowest recorded training loss (a real copy, K15).
    """
    if keep not in ("last", "best"):
        raise ValueError("keep must be 'last' or 'best'")
    if tree_depth is None:
        tree_depth = 1 if blocks.getNumPartitions() <= 64 else 2
    results, optims = [], []
    for i, spec in enumerate(specs):
        if spec.activation not in K.ACTIVATIONS:
            raise ValueError(f"activation must be one of {K.ACTIVATIONS}")
        params = init[i] if init else K.init_params(n_features, spec.hidden, spec.seed)
        results.append(FitResult(spec, params))
        optims.append(K.Adam(params, spec.learning_rate))
    best: dict[int, list] = {}
    n_passes = max(s.epochs for s in specs) + 1
    for p in range(1, n_passes + 1):
        active = [i for i, s in enumerate(specs) if p <= s.epochs + 1]
        payload = [
            {
                "params": [(w.astype(specs[i].dtype), b.astype(specs[i].dtype)) for w, b in results[i].params],
                "activation": specs[i].activation,
                "fold": -1 if specs[i].fold is None else specs[i].fold,
                "grad": p <= specs[i].epochs,
            }
            for i in active
        ]
        sums = run_pass(blocks, payload, tree_depth)
        for i, acc in zip(active, sums):
            res, spec = results[i], specs[i]
            if p >= 2 and acc["val_n"] > 0:
                res.val_loss.append(acc["val_soft"] / acc["val_n"])
            if p <= spec.epochs:
                if acc["train_n"] <= 0:
                    raise ValueError("a model has no training rows")
                res.train_loss.append(acc["train_soft"] / acc["train_n"])
                if keep == "best" and res.train_loss[-1] <= min(res.train_loss):
                    best[i] = [(w.copy(), b.copy()) for w, b in res.params]
                res.train_loss_hard.append(acc["train_hard"] / acc["train_n"])
                grads = [
                    (gw.astype(np.float64) / acc["train_n"], gb.astype(np.float64) / acc["train_n"])
                    for gw, gb in acc["grads"]
                ]
                res.params = optims[i].step(res.params, grads)
    for i, params in best.items():
        results[i].params = params
    return results


def prepare(episodes: DataFrame, vocab_codes: list[str], k: int | None = None, seed: int = 40,
            checkpoint: bool = True, partitions: int | None = None, folds: str = "exact"):
    """Training patterns with folds, checkpointed, and their cached blocks.

    ``partitions`` sets how many tasks run each epoch (default: the
    cluster's default parallelism).  Every partition shuffles one partial
    gradient per model and epoch, so per-epoch traffic is partitions x
    bundled model size: for wide models on a large cluster, use about one
    partition per executor (each task's BLAS uses the executor's cores).
    Hash partitioning on the combination keeps retries deterministic.
    """
    patterns = assign_folds(training_patterns(episodes, vocab_codes), k, seed, folds)
    n_parts = partitions or episodes.sparkSession.sparkContext.defaultParallelism
    patterns = patterns.repartition(max(n_parts, 1), "combo")
    if checkpoint:
        try:
            patterns = cut_lineage(patterns)
        except RuntimeError as exc:  # no shared checkpoint folder configured
            warnings.warn(f"{exc}; keeping the pattern lineage", stacklevel=2)
    blocks = build_blocks(patterns, len(vocab_codes))
    return patterns, blocks


def cv_objective(result_by_fold: list[FitResult]) -> float:
    """Mean validation loss over every epoch of every fold."""
    losses = [v for r in result_by_fold for v in r.val_loss]
    return float(np.mean(losses)) if losses else math.nan


def weights_table(spark, params, model_id: str = "model") -> DataFrame:
    """Weights as rows (model_id, layer, kind, i, j, value): B8 as Parquet-ready data."""
    rows = []
    for layer, (w, b) in enumerate(params):
        for (i, j), v in np.ndenumerate(w):
            rows.append((model_id, layer, "weight", int(i), int(j), float(v)))
        for i, v in enumerate(b):
            rows.append((model_id, layer, "bias", int(i), 0, float(v)))
    schema = "model_id string, layer int, kind string, i int, j int, value double"
    return spark.createDataFrame(rows, schema)


def params_from_table(df: DataFrame, model_id: str = "model") -> list:
    """Inverse of ``weights_table``: A4 (the table is one model's weights)."""
    rows = df.where(F.col("model_id") == model_id).collect()
    layers: dict[int, dict] = {}
    for r in rows:
        layers.setdefault(r.layer, {"weight": [], "bias": []})[r.kind].append((r.i, r.j, r.value))
    params = []
    for layer in sorted(layers):
        ws, bs = layers[layer]["weight"], layers[layer]["bias"]
        w = np.zeros((max(i for i, _, _ in ws) + 1, max(j for _, j, _ in ws) + 1))
        for i, j, v in ws:
            w[i, j] = v
        b = np.zeros(len(bs))
        for i, _, v in bs:
            b[i] = v
        params.append((w, b))
    return params


def save_weights(spark, params, path: str, model_id: str = "model", mode: str = "overwrite") -> None:
    """Model write as Parquet (replaces the reference's .pth file): B8."""
    weights_table(spark, params, model_id).write.mode(mode).parquet(path)


def load_weights(spark, path: str, model_id: str = "model") -> list:
    """Model read: A4."""
    return params_from_table(spark.read.parquet(path), model_id)


def score(patterns: DataFrame, params, activation: str, n_features: int) -> DataFrame:
    """Predicted risk per pattern (forward pass in Arrow batches): K13.

    Weights travel once per executor as a broadcast variable.
    """
    sc = patterns.sparkSession.sparkContext
    bc = sc.broadcast(params)

    def predict(batches):
        for pdf in batches:
            probs = K.predict_indices(bc.value, activation, pdf["idx"].tolist(), n_features)
            yield pdf.drop(columns=["idx"]).assign(risk_predicted=probs)

    base = patterns.select("combo", "idx", "n", "risk")
    schema = "combo array<string>, n bigint, risk double, risk_predicted double"
    return base.mapInPandas(predict, schema=schema).select(
        combo_key("combo").alias("combo"), "n", F.col("risk").alias("risk_true"), "risk_predicted"
    )
