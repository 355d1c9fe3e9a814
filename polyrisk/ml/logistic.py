"""Logistic risk model with MLlib on collapsed patterns (K1, K2).

Each pattern becomes two weighted rows (label 1 with weight n_pos, label 0
with weight n - n_pos); the weighted likelihood equals the likelihood of the
raw rows, so the fit is the same model on far fewer rows.  MLlib reaches the
L-BFGS optimum without regularisation, not the Adam trajectory of a fixed
number of epochs (use ``train.fit_models`` with ``hidden=()`` for that).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrisk.functions import combo_key
from polyrisk.ml.weights import NotConverged


def featurizer(vocab_codes: list[str], input_col: str = "combo") -> CountVectorizerModel:
    """Binary sparse features in vocabulary order; unknown codes are ignored (C14)."""
    return CountVectorizerModel.from_vocabulary(
        vocab_codes, inputCol=input_col, outputCol="features", binary=True
    )


def weighted_rows(patterns: DataFrame) -> DataFrame:
    """Two rows per pattern: (label 1, weight n_pos) and (label 0, weight n - n_pos)."""
    sides = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("n_pos").cast("double").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("n_pos")).cast("double").alias("weight")),
    )
    return patterns.select("combo", F.inline(sides)).where(F.col("weight") > 0)


def fit_logistic(patterns: DataFrame, vocab_codes: list[str], max_iter: int = 100, tol: float = 1e-8):
    feats = featurizer(vocab_codes)
    lr = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        regParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
    )
    # MLlib makes several passes (label scan, statistics, L-BFGS iterations,
    # summary); keep the small weighted pattern rows instead of re-running
    # the episode build for each, and release them after the fit.
    rows = feats.transform(weighted_rows(patterns)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = lr.fit(rows)
    finally:
        rows.unpersist()
    if model.summary.totalIterations >= max_iter:
        raise NotConverged(f"no optimum within {max_iter} iterations")
    return feats, model


def score_logistic(feats: CountVectorizerModel, model: LogisticRegressionModel, patterns: DataFrame) -> DataFrame:
    """Predicted risk per pattern: K13 for the logistic model."""
    scored = model.transform(feats.transform(patterns.select("combo", "n", "risk")))
    return scored.select(
        combo_key("combo").alias("combo"),
        "n",
        F.col("risk").alias("risk_true"),
        vector_to_array("probability")[1].alias("risk_predicted"),
    )
