"""Count distributions over episodes and codes (the data behind the figures).

All of them are single aggregations over ``episodes`` or its exploded form;
the reference's per-code Python loops become one group-by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrisk.operators.contingency import restrict_codes

MAX_COMBINATION_SIZE = 20


def co_exposure_histogram(episodes: DataFrame, max_size: int = MAX_COMBINATION_SIZE) -> DataFrame:
    """Per code: episodes containing it that have exactly i codes, i = 1..max_size: E12.

    Sizes above ``max_size`` are not counted (S18) but their codes still get
    a row.  Conditional counts in one hash aggregate (partial map-side),
    rather than a pivot, which would aggregate twice.
    """
    exploded = episodes.select(F.explode("combo").alias("code"), F.size("combo").alias("_size"))
    counts = [
        F.count_if(F.col("_size") == i).alias(f"count_{i}") for i in range(1, max_size + 1)
    ]
    return exploded.groupBy("code").agg(*counts)


def co_exposure_long(episodes: DataFrame) -> DataFrame:
    """(code, n_codes, episodes) for every combination size that occurs: E12 without a largest size."""
    exploded = episodes.select(F.explode("combo").alias("code"), F.size("combo").alias("n_codes"))
    return exploded.groupBy("code", "n_codes").agg(F.count(F.lit(1)).alias("episodes"))


def co_exposure_grid(histogram: DataFrame, max_size: int = 15, keep=("code",)) -> DataFrame:
    """Long form (code, n_codes, episodes) for sizes 1..max_size: F7 (5 x 3 grid)."""
    cells = F.array(
        *[F.struct(F.lit(i).alias("n_codes"), F.col(f"count_{i}").alias("episodes")) for i in range(1, max_size + 1)]
    )
    return histogram.select(*keep, F.inline(cells))


def record_size_histogram(episodes: DataFrame, include_outcome: bool = False) -> DataFrame:
    """Number of episodes per record size: E14 + E11.

    ``include_outcome=True`` reproduces the reference's row sum, which also
    adds the 0/1 outcome to the code count (S17).
    """
    size = F.col("n_codes") + (F.col("outcome") if include_outcome else F.lit(0))
    return episodes.groupBy(size.alias("n_codes")).agg(F.count(F.lit(1)).alias("episodes"))


def codes_per_episode(episodes: DataFrame, codes) -> DataFrame:
    """Per episode, how many of the listed codes it has; episodes with none
    are absent (they had no rows after the membership filter): E4 + D2."""
    kept = restrict_codes(episodes, codes)
    return kept.select("subject_id", "episode_id", "outcome", "n_codes").where(F.col("n_codes") > 0)


def size_by_class(sizes: DataFrame) -> DataFrame:
    """Episodes per (size, outcome): E13."""
    return sizes.groupBy("n_codes", "outcome").agg(F.count(F.lit(1)).alias("episodes"))


def equal_width_histogram(values: DataFrame, value_col: str, group_col: str | None = None) -> DataFrame:
    """Equal-width bins with k = number of distinct values: E15.

    Range and k come from the whole column; counts are per ``group_col`` when
    given.  The last bin is closed on the right; a zero-width range puts
    everything in bin 1.  Integer-valued columns are binned with exact
    integer arithmetic.  The values are first counted per (group, value) --
    one hash aggregate -- and both the bounds and the bins are computed from
    that small table.
    """
    keys = [group_col] if group_col else []
    v = F.col(value_col)
    counts = values.where(v.isNotNull()).groupBy(*keys, v.alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    # One row (min, max, k) fetched eagerly: inlining it as a scalar subquery
    # would re-plan any subqueries already inside ``values``.
    b = counts.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count_distinct("_x").alias("k")).first()
    x_type = counts.schema["_x"].dataType
    lo, hi = F.lit(b.lo).cast(x_type), F.lit(b.hi).cast(x_type)
    k = F.lit(b.k).cast("bigint")
    x = F.col("_x")
    width = hi - lo
    bin_index = F.when(width == 0, F.lit(1).cast("bigint")).otherwise(
        F.least(F.floor(((x - lo) * k) / width).cast("bigint") + 1, k)
    )
    binned = counts.select(*keys, bin_index.alias("bin"), "_c")
    per_bin = binned.groupBy(*keys, "bin").agg(F.sum("_c").cast("bigint").alias("episodes"))
    edge_lo = lo + (width * (F.col("bin") - 1)) / k
    edge_hi = lo + (width * F.col("bin")) / k
    return per_bin.select(
        *keys,
        "bin",
        edge_lo.cast("double").alias("bin_lo"),
        F.when(width == 0, hi.cast("double")).otherwise(edge_hi.cast("double")).alias("bin_hi"),
        "episodes",
    )
