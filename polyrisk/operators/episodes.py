"""Episodes: the long exposure table grouped into exact code combinations.


    exposures  subject_id, episode_id, code STRING, outcome INT
    episodes   subject_id, episode_id, outcome INT, combo ARRAY<STRING>, n_codes INT

The array is the reference's 0/1 row in sparse form: sorted, distinct, and
usable directly as an exact group key (no hashing, no collisions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPISODE_KEYS = ["subject_id", "episode_id", "outcome"]


def distinct_exposures(df: DataFrame) -> DataFrame:
    """Projection to the four canonical columns, then row distinct: C1 + E1."""
    return df.select("subject_id", "episode_id", "code", "outcome").distinct()


def build_episodes(exposures: DataFrame) -> DataFrame:
    """Multi-hot pivot in long form: E2.

    Rows with a null key are dropped (pandas group-by semantics, S1); a null
    code does not drop its episode, it just contributes no code (S2).  The
    outcome is part of the key, so conflicting outcomes give two rows (S4).
    ``collect_set`` aggregates partially map-side, which keeps a hot episode
    from arriving at one reducer as raw rows.
    """
    keyed = exposures.where(
        F.col("subject_id").isNotNull()
        & F.col("episode_id").isNotNull()
        & F.col("outcome").isNotNull()
    )
    combo = F.sort_array(F.collect_set("code"))
    grouped = keyed.groupBy(*EPISODE_KEYS).agg(combo.alias("combo"))
    return grouped.withColumn("n_codes", F.size("combo"))


def non_empty(episodes: DataFrame) -> DataFrame:
    """Episodes with at least one code: C6 (S3)."""
    return episodes.where(F.size("combo") > 0)


def exposures_of(episodes: DataFrame) -> DataFrame:
    """Back to the distinct long table: one row per (episode, code)."""
    return episodes.select(*EPISODE_KEYS, F.explode("combo").alias("code"))


def dataset_profile(raw_rows: DataFrame | None, episodes: DataFrame, n_raw=None, n_distinct=None) -> DataFrame:
    """Dataset counts printed by the reference's cleaning step: E16 + E6.

    One row: raw rows, distinct exposures, episodes, subjects, codes and the
    class balance.  The raw count and the code count are scalar subqueries,
    so the whole profile is a single lazy plan; ``n_raw`` and ``n_distinct``
    may supply the counts of raw and distinct rows as columns (e.g.
    ``sources.tables.raw_row_count(...).scalar()``).  Distinct rows are
    counted before rows with a null key are dropped.
    """
    if n_raw is None:
        n_raw = raw_rows.agg(F.count(F.lit(1))).scalar()
    if n_distinct is None:
        n_distinct = distinct_exposures(raw_rows).agg(F.count(F.lit(1))).scalar()
    n_codes = exposures_of(episodes).agg(F.count_distinct("code")).scalar()
    return episodes.agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.count_distinct("subject_id").alias("n_subjects"),
        F.count_if(F.col("outcome") == 1).alias("n_outcome_1"),
        F.count_if(F.col("outcome") == 0).alias("n_outcome_0"),
    ).select(
        n_raw.alias("n_rows_raw"),
        n_distinct.alias("n_exposures"),
        "n_episodes",
        "n_subjects",
        n_codes.alias("n_codes"),
        "n_outcome_0",
        "n_outcome_1",
    )


def sort_by_size(episodes: DataFrame) -> DataFrame:
    """Episodes ordered by number of codes: F4 (for display/sinks only)."""
    return episodes.orderBy("n_codes", "subject_id", "episode_id", "outcome")
