"""Deterministic sampling and splitting by hash.

The reference samples with seeded permutations (pandas / scikit-learn).  A
permutation needs a global order; here selection is a threshold on a seeded
md5 bucket of the key, decided row by row with no shuffle, identical in every
engine and on every re-run of a lost task.  The contract is: deterministic
per seed, with inclusion probability = fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyrisk.functions import combo_identity, hash_unit, ratio, unit_threshold

DEFAULT_SEED = 40  # the reference's sample_random_state (config)


def combo_bucket(seed: int, combo_col: str = "combo") -> Column:
    return hash_unit(seed, combo_identity(combo_col))


def episode_bucket(seed: int) -> Column:
    return hash_unit(seed, _episode_key())


def group_sample(
    episodes: DataFrame, fraction: float, seed: int = DEFAULT_SEED, combo_col: str = "combo"
) -> DataFrame:
    """Sample whole combinations, keeping all their rows: J1.

    No semi-join: every row of a combination computes the same bucket.
    ``fraction=1`` keeps everything (the reference's training setting).
    """
    return episodes.where(combo_bucket(seed, combo_col) < F.lit(unit_threshold(fraction)))


def _combo_cut(episodes: DataFrame, fraction: float, seed: int, combo_col: str):
    """(m, cut tuple or None, r): the hash-order cut after exactly
    round(fraction * m) of the m distinct combinations."""
    combos = (
        episodes.select(combo_identity(combo_col).alias("_key"))
        .distinct()
        .withColumn("_h1", hash_unit(seed, F.col("_key")))
    )
    m, cuts = _hash_order(combos, seed, lambda m: [round(fraction * m)])
    r = round(fraction * m)
    return m, cuts.get(r), r


def _combo_selected(episodes: DataFrame, fraction: float, seed: int, combo_col: str) -> Column:
    m, cut, r = _combo_cut(episodes, fraction, seed, combo_col)
    if r <= 0:
        return F.lit(False)
    if r >= m:
        return F.lit(True)
    key = combo_identity(combo_col)
    return ~_at_or_after(cut, seed, hash_unit(seed, key), key)


def group_sample_exact(
    episodes: DataFrame, fraction: float, seed: int = DEFAULT_SEED, combo_col: str = "combo"
) -> DataFrame:
    """Exactly round(fraction * m) of the m distinct combinations, with all
    their rows (the reference samples its distinct combination hashes with
    a fixed size): J1 exact.  One exact cut point of the combinations' hash
    order, then a narrow filter on each row's own combination: no join."""
    return episodes.where(_combo_selected(episodes, fraction, seed, combo_col))


def holdout_unseen_exact(
    episodes: DataFrame, fraction: float, seed: int = DEFAULT_SEED, combo_col: str = "combo"
) -> DataFrame:
    """The complement of ``group_sample_exact``: J5 / D4 exact."""
    return episodes.where(~_combo_selected(episodes, fraction, seed, combo_col))


def holdout_unseen(
    episodes: DataFrame, fraction: float, seed: int = DEFAULT_SEED, combo_col: str = "combo"
) -> DataFrame:
    """The complement of ``group_sample``: combinations never seen in training: J5 / D4."""
    return episodes.where(combo_bucket(seed, combo_col) >= F.lit(unit_threshold(fraction)))


def kfold_assign(patterns: DataFrame, k: int = 3, seed: int = DEFAULT_SEED, combo_col: str = "combo") -> DataFrame:
    """Group K-fold: each combination lands in exactly one fold 0..k-1: J4.

    Folds are near-equal in combinations (hash buckets), not exactly equal as
    a shuffled K-fold split would be.
    """
    return patterns.withColumn("fold", F.pmod(combo_bucket(seed, combo_col), F.lit(k)).cast("int"))


def _episode_key() -> Column:
    """Subject, episode and outcome: conflicting outcomes are two episodes.

    One text for each triple, whatever marks or nulls the ids hold.
    """
    return combo_identity(F.array(*(F.col(k).cast("string") for k in ("subject_id", "episode_id", "outcome"))))


def second_bucket(seed: int, key: Column) -> Column:
    """Bits 33-64 of the same md5 digest: the tie-breaker of ``hash_unit``."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")


def exact_row_sample(episodes: DataFrame, fraction: float, seed: int = DEFAULT_SEED) -> DataFrame:
    """Exactly round(fraction * n) episodes (a fixed-size sample, as
    ``sample(frac=...)`` returns; Python rounding, half to even): J2 exact-n.

    The episodes with the smallest (hash bucket, second bucket, key) are
    taken.  No global sort: the cut of the hash order is found by distributed
    histograms (``_hash_order``), and a filter takes the rows before it.
    """
    key = _episode_key()
    keyed = episodes.withColumn("_h1", hash_unit(seed, key)).withColumn("_key", key)
    n, cuts = _hash_order(keyed, seed, lambda n: [round(fraction * n)])
    k = round(fraction * n)
    if k <= 0:
        return episodes.where(F.lit(False))
    if k >= n:
        return episodes
    return keyed.where(~_at_or_after(cuts[k], seed)).drop("_h1", "_key")


def _hash_order(keyed: DataFrame, seed: int, ranks_of) -> tuple[int, dict[int, tuple]]:
    """(n, rank -> cut) of the order by (_h1, second bucket, _key).

    ``ranks_of(n)`` names the wanted 0-based ranks; those outside 1..n-1 need
    no cut and get none.  The input is computed once; the rows tied on all cut
    buckets (about n / 2**32 for each) are fetched by one job.
    """
    from pyspark import StorageLevel
    from pyspark.sql import types as T

    from polyrisk.operators.describe import group_bounds, order_statistics

    base = keyed.select(F.lit(0).alias("_g"), F.col("_h1").cast("double").alias("_v"), "_key")
    base = base.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        groups = group_bounds(base)
        n = groups[0].n if groups else 0
        ranks = sorted({r for r in ranks_of(n) if 0 < r < n})
        if not ranks:
            return n, {}
        stats = order_statistics(keyed.sparkSession, base.select("_g", "_v"), T.IntegerType(), groups, {0: ranks})
        buckets = sorted({stats[(0, r)][0] for r in ranks})
        tied = base.where(F.col("_v").isin(buckets)).groupBy("_v", second_bucket(seed, F.col("_key")).alias("_h2"), "_key")
        tied = sorted((r._v, r._h2, r._key, r.c) for r in tied.agg(F.count(F.lit(1)).alias("c")).collect())
    finally:
        base.unpersist()
    cuts = {}
    for rank in ranks:
        value, at = stats[(0, rank)]
        for v, h2, key, c in tied:
            if v == value:
                at += c
                if at > rank:
                    cuts[rank] = (int(v), int(h2), key)
                    break
    return n, cuts


def _at_or_after(cut: tuple, seed: int, h1c: Column | None = None, keyc: Column | None = None) -> Column:
    """Whether a row's (bucket, second bucket, key) is at or after ``cut``."""
    t, h2, key = cut
    h1c = F.col("_h1") if h1c is None else h1c
    keyc = F.col("_key") if keyc is None else keyc
    h2c = second_bucket(seed, keyc)
    return (h1c > F.lit(t)) | (
        (h1c == F.lit(t)) & ((h2c > F.lit(h2)) | ((h2c == F.lit(h2)) & (keyc >= F.lit(key))))
    )


def kfold_assign_exact(
    patterns: DataFrame, k: int = 3, seed: int = DEFAULT_SEED, combo_col: str = "combo", risk_col: str | None = None
) -> DataFrame:
    """Group K-fold with exactly equal fold sizes (the first m % k folds one
    larger, as a shuffled K-fold split makes them): J4 exact variant.

    The m distinct groups (combinations, or combination and ``risk_col``: S9)
    are ordered by (hash bucket, second bucket, key); the k - 1 fold boundaries
    are exact order statistics of that order, and a row's fold is the number
    of boundaries at or before its group: no global sort or window.  Fewer
    groups than folds would leave a fold empty, which is an error.
    """
    key = combo_identity(combo_col)
    if risk_col:
        # A rate's first 53 binary places: exact in every engine, distinct for all counts below 2**26.
        key = F.concat_ws("|", key, F.floor(F.col(risk_col) * F.lit(float(1 << 53))).cast("string"))
    keyed = patterns.withColumn("_h1", hash_unit(seed, key)).withColumn("_key", key)

    def starts(m: int) -> list[int]:
        return [i * (m // k) + min(i, m % k) for i in range(1, k)]

    m, cuts = _hash_order(keyed.select("_h1", "_key").distinct(), seed, starts)
    if 0 < m < k:
        raise ValueError(f"{m} groups cannot fill {k} folds")
    fold = sum((_at_or_after(c, seed).cast("int") for c in cuts.values()), F.lit(0))
    return keyed.withColumn("fold", fold.cast("int")).drop("_h1", "_key")


def row_sample(episodes: DataFrame, fraction: float, seed: int = DEFAULT_SEED) -> DataFrame:
    """Row sample without replacement by episode key: J2."""
    return episodes.where(episode_bucket(seed) < F.lit(unit_threshold(fraction)))


def sampling_error(
    episodes: DataFrame,
    fractions: Sequence[float] = (0.25, 0.5, 0.75, 1.0),
    seed: int = 42,
    min_count: int = 2,
    combo_col: str = "combo",
    exact: bool = False,
) -> DataFrame:
    """Risk on a row sample minus risk on all rows, per shared combination: J3 + D5.

    The reference runs the frequency filter, then per fraction computes
    combination risk twice and joins.  Here one aggregation per combination
    carries the full counts and the sampled counts of every fraction
    (conditional sums on the episode's hash bucket), the frequency filter
    (n > min_count) is applied after it, and fractions are unpivoted:
    a single shuffle for all fractions, no join.  A combination absent from
    a sample has no row for that fraction (inner-join semantics).

    ``exact=True`` draws fixed-size samples as the reference does (exactly
    round(f * n) of the n frequent episodes, nested across fractions): the
    frequency filter moves before sampling (one semi-join), and each
    fraction's sample is everything before one exact cut point of the hash
    order (see ``exact_row_sample``).
    """
    if exact:
        from polyrisk.operators.patterns import frequent_episodes

        key = _episode_key()
        episodes = (
            frequent_episodes(episodes, min_count, combo_col)
            .withColumn("_h1", hash_unit(seed, key))
            .withColumn("_key", key)
        )
        n_all, cut_at = _hash_order(episodes, seed, lambda n: [round(f * n) for f in fractions])
        ranks = [round(f * n_all) for f in fractions]

        def inside_of(i, fraction):
            r = ranks[i]
            if r <= 0:
                return F.lit(False)
            if r >= n_all:
                return F.lit(True)
            return ~_at_or_after(cut_at[r], seed)
    else:
        bucket = episode_bucket(seed)

        def inside_of(i, fraction):
            return bucket < F.lit(unit_threshold(fraction))

    aggs = [F.count(F.lit(1)).alias("n"), F.sum("outcome").cast("bigint").alias("n_pos")]
    for i, fraction in enumerate(fractions):
        inside = inside_of(i, fraction)
        aggs.append(F.count_if(inside).alias(f"_n{i}"))
        aggs.append(F.sum(F.when(inside, F.col("outcome")).otherwise(0)).cast("bigint").alias(f"_p{i}"))
    per_combo = episodes.groupBy(F.col(combo_col).alias("combo")).agg(*aggs).where(F.col("n") > min_count)
    samples = F.array(
        *[
            F.struct(
                F.lit(float(f)).alias("fraction"),
                F.col(f"_n{i}").alias("n_sample"),
                F.col(f"_p{i}").alias("n_pos_sample"),
            )
            for i, f in enumerate(fractions)
        ]
    )
    long = per_combo.select("combo", "n", "n_pos", F.inline(samples)).where(F.col("n_sample") > 0)
    risk_full = ratio("n_pos", "n")
    risk_sample = ratio("n_pos_sample", "n_sample")
    return long.select(
        "fraction",
        "combo",
        "n",
        "n_sample",
        risk_full.alias("risk_full"),
        risk_sample.alias("risk_sample"),
        (risk_full - risk_sample).alias("error"),
    )


def errors_wide(errors: DataFrame, fractions: Sequence[float] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """One row per combination, one error column per fraction: D7.

    The reference pads four unequal-length error series by position; pairing
    by position is meaningless, so the columns are aligned on the
    combination instead (NULL where the combination was not sampled).
    One conditional aggregation, no pivot value discovery.
    """
    cols = [
        F.max(F.when(F.col("fraction") == F.lit(float(f)), F.col("error"))).alias(f"error_{round(f * 100)}")
        for f in fractions
    ]
    return errors.groupBy("combo").agg(*cols)
