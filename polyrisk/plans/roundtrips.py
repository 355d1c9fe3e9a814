"""Queries that write a table in one of the file formats and read it back.

Files go to a new folder below ``spark.checkpoint.dir``; the result is what a
reader of the files gets, so it must equal the table that was written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyrisk import sinks
from polyrisk.operators import episodes as E
from polyrisk.operators import vocab as V
from polyrisk.operators.patterns import combo_patterns
from polyrisk.plans import catalog as Q
from polyrisk.plans import params as P
from polyrisk.session import ensure_checkpoint_dir
from polyrisk.sources import files, tables


def _path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/format-{name}-{uuid.uuid4().hex}"


def _csv(df: DataFrame, name: str) -> DataFrame:
    spark, path = df.sparkSession, _path(df.sparkSession, name)
    sinks.write_csv(df, path)
    return spark.read.schema(df.schema).option("header", True).csv(path)


def q_format_long_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw long rows (A1), then their distinct."""
    path = _path(spark, "long")
    sinks.write_csv(sinks.with_reference_names(tables.exposure_rows(spark, sf_dir, P.CODE)), path)
    back = files.read_long_csv(spark, path)
    return E.distinct_exposures(back.withColumn("episode_id", F.col("episode_id").cast("bigint")))


def q_format_multi_hot_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide 0/1 table, one column a code (B1, A2)."""
    ep, path = Q._episodes(spark, sf_dir), _path(spark, "wide")
    vocab = V.ordered_vocabulary(E.exposures_of(ep).select("code").distinct(), [])
    sinks.write_multi_hot_csv(ep, vocab, path)
    back = files.read_multi_hot_csv(spark, path, key_columns=("subject_id", "episode_id"), outcome_column="outcome")
    return Q._episode_out(back.withColumn("episode_id", F.col("episode_id").cast("bigint")))


def q_format_vocabulary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary as one JSON document of marked column names (A3)."""
    path = _path(spark, "vocabulary")
    sinks.write_vocabulary_json(Q.q_vocab_frequent(spark, sf_dir), path)
    return files.read_vocabulary_json(spark, path)


def q_format_code_stats_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-code statistics (B2)."""
    return _csv(Q.q_code_contingency(spark, sf_dir), "stats")


def q_format_screens_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three screens, one folder each."""
    screens, path = Q.q_code_risk_screen(spark, sf_dir), _path(spark, "screens")
    sinks.write_screens(screens, path)
    return spark.read.schema(screens.schema).option("header", True).csv(path).select(*screens.columns)


def q_format_scores_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored combinations, with their codes read back as arrays."""
    ep, path = Q._episodes(spark, sf_dir), _path(spark, "scores")
    scores = Q._fixed_scores(ep, combo_patterns(ep))
    sinks.write_csv(scores, path)
    return Q._show_combo(files.read_csv(spark, path, scores.schema))


FORMAT_QUERIES = {
    "format_long_csv": q_format_long_csv,
    "format_multi_hot_csv": q_format_multi_hot_csv,
    "format_vocabulary_json": q_format_vocabulary_json,
    "format_code_stats_csv": q_format_code_stats_csv,
    "format_screens_csv": q_format_screens_csv,
    "format_scores_csv": q_format_scores_csv,
}
