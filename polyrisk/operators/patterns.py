"""Combination risk: the empirical outcome rate of each exact code set.

    patterns  combo ARRAY<STRING>, n LONG, n_pos LONG, risk DOUBLE
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrisk.functions import ratio


def combo_patterns(episodes: DataFrame, combo_col: str = "combo") -> DataFrame:
    """Combination risk = mean(outcome) per identical code set: E3.

    A single hash aggregate; the partial aggregate runs map-side, so the most
    common combination (often a third of all episodes) costs one row per map
    task in the shuffle.
    """
    return (
        episodes.groupBy(F.col(combo_col).alias("combo"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("outcome").cast("bigint").alias("n_pos"),
        )
        .withColumn("risk", ratio("n_pos", "n"))
    )


def attach_risk(episodes: DataFrame, patterns: DataFrame, combo_col: str = "combo") -> DataFrame:
    """Row-level risk: each episode gets its combination's risk: D1.

    An equi-join on the combination rather than a window partitioned by it: a
    window would place a hot combination's rows in one task, while the join
    lets AQE broadcast a small pattern table or split a skewed partition.
    The 64-bit hash of the combination leads the join keys, so a sort-merge
    join sorts mostly on a long; array equality keeps the match exact.
    """
    risk = patterns.select(
        F.xxhash64("combo").alias("_rh"), F.col("combo").alias("_risk_combo"), "risk"
    )
    keyed = episodes.withColumn("_eh", F.xxhash64(combo_col))
    joined = keyed.join(
        risk, (F.col("_eh") == F.col("_rh")) & (keyed[combo_col] == F.col("_risk_combo"))
    )
    return joined.drop("_risk_combo", "_rh", "_eh")


def frequent_episodes(episodes: DataFrame, min_count: int = 2, combo_col: str = "combo") -> DataFrame:
    """Episodes whose combination occurs more than ``min_count`` times: C12."""
    frequent = (
        combo_patterns(episodes, combo_col)
        .where(F.col("n") > min_count)
        .select(F.xxhash64("combo").alias("_fh"), F.col("combo").alias("_freq_combo"))
    )
    keyed = episodes.withColumn("_eh", F.xxhash64(combo_col))
    cond = (F.col("_eh") == F.col("_fh")) & (keyed[combo_col] == F.col("_freq_combo"))
    return keyed.join(frequent, cond, "left_semi").drop("_eh")


def risk_frequency(risk_rows: DataFrame, combo_col: str = "combo") -> DataFrame:
    """``value_counts`` over (codes, risk): distinct pairs with counts: E5.

    After vocabulary alignment several full combinations can collapse into
    one aligned combination with different risks (S8); each pair is a row.
    """
    return risk_rows.groupBy(F.col(combo_col).alias("combo"), "risk").agg(
        F.count(F.lit(1)).alias("n")
    )
