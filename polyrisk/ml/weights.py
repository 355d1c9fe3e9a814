"""Linear risk models as weight tables: features, fit, scores and proof.

    weights  code STRING (null: intercept), weight DOUBLE

A model is a table, and so are its inputs: codes meet their column numbers and
weights by joins, whatever the size of the vocabulary.  Only the MLlib fit
itself holds one number a code on the driver.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from polyrisk.operators.scan import ranked
from polyrisk.session import materialise

MAX_ITER = 1000
#: Relative change of the loss at which L-BFGS stops: the gradient is then about its square root.
TOLERANCE = 1e-12


class NotConverged(RuntimeError):
    """Raised when the optimiser used up its iterations."""


def code_index(patterns: DataFrame) -> DataFrame:
    """(code, index): the codes of ``patterns`` numbered from 0 in code order."""
    codes = patterns.select(F.explode("combo").alias("code")).where("code IS NOT NULL").distinct()
    return ranked(codes, [F.asc("code")], "index")


def feature_rows(patterns: DataFrame, index: DataFrame) -> DataFrame:
    """(combo, n, n_pos, indices): each distinct combination with its columns, ascending (C14).

    Rows of one combination are added up, as the likelihood asks; codes that
    are not in ``index`` are no columns (lenient alignment), and a combination
    without any has an empty list.
    """
    counts = patterns.groupBy("combo").agg(F.sum("n").cast("bigint").alias("n"), F.sum("n_pos").cast("bigint").alias("n_pos"))
    terms = counts.select("combo", "n", "n_pos", F.explode_outer("combo").alias("code")).join(index, "code", "left")
    return terms.groupBy("combo", "n", "n_pos").agg(F.sort_array(F.collect_set("index")).alias("indices"))


def sparse_rows(features: DataFrame, size: int) -> DataFrame:
    """(label, weight, features): two weighted rows a combination, with MLlib's sparse vectors.

    The vectors are written as plain structs and read back under their own
    type, so no row passes through Python.
    """
    sides = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("n_pos").cast("double").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("n_pos")).cast("double").alias("weight")),
    )
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.col("indices"),
        F.transform("indices", lambda _: F.lit(1.0)).alias("values"),
    )
    rows = features.select(vector.alias("features"), F.inline(sides)).where("weight > 0").select("label", "weight", "features")
    written = materialise(rows, "sparse-rows")
    schema = StructType([StructField("label", DoubleType()), StructField("weight", DoubleType()), StructField("features", VectorUDT())])
    return written.sparkSession.read.schema(schema).parquet(*{f.rsplit("/", 1)[0] for f in written.inputFiles()})


def fit_logistic_weights(patterns: DataFrame, max_iter: int = MAX_ITER, tol: float = TOLERANCE, reg: float = 0.0) -> DataFrame:
    """The logistic risk model of ``patterns(combo, n, n_pos)`` as a weight table: K1.

    Maximum likelihood (with ridge penalty ``reg`` if given) on collapsed rows.
    Patterns with one outcome only have no finite fit, and an optimiser that
    does not come to an end gives no model: both are errors.
    """
    n, n_pos = patterns.agg(F.sum("n"), F.sum("n_pos")).first()
    if not n_pos or n_pos == n:
        raise ValueError("a fit needs both outcomes")
    index = code_index(patterns)
    size = index.count()
    if not size:
        raise ValueError("a fit needs at least one code")
    rows = sparse_rows(feature_rows(patterns, index), size).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = LogisticRegression(weightCol="weight", regParam=reg, standardization=False, maxIter=max_iter, tol=tol).fit(rows)
    finally:
        rows.unpersist()
    if model.summary.totalIterations >= max_iter:
        raise NotConverged(f"no optimum within {max_iter} iterations")
    spark = patterns.sparkSession
    found = spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.coefficients)], "index int, weight double")
    intercept = spark.createDataFrame([(None, float(model.intercept))], "code string, weight double")
    return index.join(found, "index").select("code", "weight").unionByName(intercept)


def log_odds_weights(code_stats: DataFrame) -> DataFrame:
    """Weights in closed form: a code's log odds with it less those without it (0 where undefined)."""
    odds = F.log(F.col("p_pos_drug") / F.col("p_neg_drug")) - F.log(F.col("p_pos_nodrug") / F.col("p_neg_nodrug"))
    return code_stats.select("code", F.coalesce(odds, F.lit(0.0)).alias("weight"))


def linear_scores(patterns: DataFrame, weights: DataFrame) -> DataFrame:
    """``patterns`` with risk_predicted, the sigmoid of intercept and weights: K13, K14.

    Codes without a weight add nothing (lenient alignment); a model without
    intercept has 0.
    """
    # The intercept is the weight of the null code, which every combination has once.
    codes = F.explode(F.concat(F.array_compact("combo"), F.array(F.lit(None).cast("string"))))
    terms = patterns.select("combo").distinct().select("combo", codes.alias("code"))
    known = weights.select(F.col("code").alias("_known"), "weight")
    terms = terms.join(known, F.col("code").eqNullSafe(F.col("_known")), "left")
    sums = terms.groupBy("combo").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("_z"))
    risk = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z")))
    return patterns.join(sums, "combo").withColumn("risk_predicted", risk).drop("_z")


def score_patterns(patterns: DataFrame, weights: DataFrame) -> DataFrame:
    """(combo, n, risk_true, risk_predicted) of ``patterns(combo, n, risk)``."""
    return linear_scores(patterns, weights).select("combo", "n", F.col("risk").alias("risk_true"), "risk_predicted")


def loss_gradient(patterns: DataFrame, weights: DataFrame) -> DataFrame:
    """(code, n, n_pos, gradient) of the mean loss at ``weights``, by code (null: intercept).

    Zero in every row proves a fit without penalty optimal, as the loss is
    convex.  n and n_pos count the rows with the code.
    """
    rows = patterns.agg(F.sum("n")).scalar()
    excess = (F.col("n") * F.col("risk_predicted") - F.col("n_pos")).alias("excess")
    codes = F.explode(F.concat("combo", F.array(F.lit(None).cast("string")))).alias("code")
    terms = linear_scores(patterns, weights).select(codes, "n", "n_pos", excess)
    per_code = terms.groupBy("code").agg(F.sum("n").cast("bigint").alias("n"), F.sum("n_pos").cast("bigint").alias("n_pos"), F.sum("excess").alias("e"))
    return per_code.select("code", "n", "n_pos", (F.col("e") / rows).alias("gradient"))


def write_weights(weights: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a model: B8."""
    weights.select("code", "weight").write.mode(mode).parquet(path)


def read_weights(spark, path: str) -> DataFrame:
    """A stored model: A4."""
    return spark.read.schema("code string, weight double").parquet(path)
