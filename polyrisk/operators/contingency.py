"""Per-code contingency statistics, the three-way screen and exclusion.

    code_stats  code, count_outcome_0, count_outcome_1,
                p_neg_nodrug, p_neg_drug, p_pos_nodrug, p_pos_drug

``p_<class>_<exposure>`` = P(outcome = class | exposure), e.g. ``p_pos_drug``
= P(outcome = 1 | code present).  The reference computes J x (2 counts + 4
conditional probabilities) as masked column sums over a wide matrix; here it
is one aggregation over the exploded episodes plus the class totals, because
every "without the code" count is a total minus a "with the code" count.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyrisk.functions import ratio, round_half_even
from polyrisk.operators.episodes import EPISODE_KEYS, exposures_of, non_empty

SCREEN_KEPT = "kept"
SCREEN_REMOVED = "removed"
SCREEN_END = "end"


def code_contingency(episodes: DataFrame, require_non_empty: bool = True) -> DataFrame:
    """Exposed counts by class and the four conditional probabilities: E7 + E8.

    Totals over episodes (N0, N1) enter as scalar subqueries, i.e. one small
    job whose single row is inlined into the per-code projection, instead of
    a join.  0/0 gives NULL (S5).
    """
    base = non_empty(episodes) if require_non_empty else episodes
    per_code = exposures_of(base).groupBy("code").agg(
        F.count_if(F.col("outcome") == 0).alias("count_outcome_0"),
        F.count_if(F.col("outcome") == 1).alias("count_outcome_1"),
    )
    totals = base.agg(
        F.struct(
            F.count_if(F.col("outcome") == 0).alias("n0"),
            F.count_if(F.col("outcome") == 1).alias("n1"),
        )
    ).scalar()
    n0, n1 = totals.getField("n0"), totals.getField("n1")
    c0, c1 = F.col("count_outcome_0"), F.col("count_outcome_1")
    exposed = c0 + c1
    unexposed = (n0 + n1) - exposed
    return per_code.select(
        "code",
        "count_outcome_0",
        "count_outcome_1",
        ratio(n0 - c0, unexposed).alias("p_neg_nodrug"),
        ratio(c0, exposed).alias("p_neg_drug"),
        ratio(n1 - c1, unexposed).alias("p_pos_nodrug"),
        ratio(c1, exposed).alias("p_pos_drug"),
    )


def screen_label(thres: int) -> Column:
    """Three-way screen: C8 + C9 + C10.

    ``end``: lower risk with the code (no support threshold);
    ``kept`` / ``removed``: at least as risky, with total support >= / <
    ``thres``; NULL when a probability is undefined (such codes fall in no
    screen in the reference either).
    """
    nodrug, drug = F.col("p_pos_nodrug"), F.col("p_pos_drug")
    total = F.col("count_outcome_0") + F.col("count_outcome_1")
    return (
        F.when(nodrug > drug, F.lit(SCREEN_END))
        .when((nodrug <= drug) & (total >= thres), F.lit(SCREEN_KEPT))
        .when((nodrug <= drug) & (total < thres), F.lit(SCREEN_REMOVED))
    )


def screen_codes(code_stats: DataFrame, thres: int = 0) -> DataFrame:
    """Screened codes with the reference's output projection: E9 + H6 + F2.

    Probabilities are rounded half-to-even to 2 places after the screen was
    decided on unrounded values; ``rank`` is the 0-based position inside the
    code's screen, ordered by unrounded P(pos | code) descending (ties by
    code).  The per-code table is small (one row per distinct code), so the
    ranking window is cheap.
    """
    labelled = code_stats.withColumn("screen", screen_label(thres))
    order = Window.partitionBy("screen").orderBy(F.desc_nulls_last("p_pos_drug"), F.asc("code"))
    return labelled.select(
        "screen",
        (F.row_number().over(order) - 1).alias("rank"),
        "code",
        round_half_even("p_pos_nodrug", 2).alias("p_pos_nodrug"),
        round_half_even("p_pos_drug", 2).alias("p_pos_drug"),
        "count_outcome_0",
        "count_outcome_1",
    )


def codes_in(screened: DataFrame, screen: str) -> DataFrame:
    return screened.where(F.col("screen") == screen).select("code")


#: Longer code lists are joined; shorter ones become literals of the plan (one hash lookup for each code).
INLINE_CODES = 10_000


def inline_codes(codes) -> list[str] | None:
    """The distinct codes of a per-code table, or None where there are more than ``INLINE_CODES``.

    A list is returned as it is.  No more than the bound reaches the driver.
    """
    if not isinstance(codes, DataFrame):
        return list(codes)
    rows = codes.select("code").where(F.col("code").isNotNull()).distinct().limit(INLINE_CODES + 1).collect()
    return sorted(r.code for r in rows) if len(rows) <= INLINE_CODES else None


def fetch_screen_code_sets(screened: DataFrame) -> dict[str, list[str] | DataFrame]:
    """The kept / removed / end lists of a screen: fetched in one small job, or
    as per-code tables where there are more codes than may be inlined."""
    labels = (SCREEN_KEPT, SCREEN_REMOVED, SCREEN_END)
    rows = screened.where(F.col("screen").isNotNull()).select("screen", "code").limit(INLINE_CODES + 1).collect()
    if len(rows) > INLINE_CODES:
        return {s: codes_in(screened, s) for s in labels}
    return {s: sorted(r.code for r in rows if r.screen == s) for s in labels}


def is_listed(code: Column, codes: list[str]) -> Column:
    return code.isin(codes) if codes else F.lit(False)


def same_episode(prefix: str) -> Column:
    """Null-safe: a null subject or episode is a key value like any other."""
    return reduce(and_, (F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in EPISODE_KEYS))


def _listed_exposures(episodes: DataFrame, codes: DataFrame) -> DataFrame:
    return exposures_of(episodes).join(codes.select("code").distinct(), "code", "left_semi")


def exclude_exposed(episodes: DataFrame, codes, method: str = "inline") -> DataFrame:
    """Drop every episode exposed to any listed code: D3.

    ``codes`` is a per-code table or a list.  ``inline`` is a narrow filter
    (``exists`` with a hashed IN list) that shuffles nothing; tables of more
    than ``INLINE_CODES`` codes and ``join`` find the exposed episodes' keys by
    a semi-join and remove them with an anti-join.  Removing the code's column
    is implied: no surviving episode contains it.
    """
    if method not in ("inline", "join"):
        raise ValueError(f"method must be 'inline' or 'join', got {method!r}")
    listed = inline_codes(codes) if method == "inline" else None
    if listed is not None:
        exposed = F.exists("combo", lambda c: is_listed(c, listed))
        return episodes.where(~F.coalesce(exposed, F.lit(False)))
    if not isinstance(codes, DataFrame):
        raise ValueError("method='join' needs the codes as a DataFrame")
    exposed = _listed_exposures(episodes, codes).select(*(F.col(k).alias(f"x_{k}") for k in EPISODE_KEYS)).distinct()
    return episodes.join(exposed, same_episode("x_"), "left_anti")


def exclusion_counts(episodes: DataFrame, codes) -> DataFrame:
    """Episodes exposed to each listed code, counted on the input: E10.

    ``codes`` is a per-code table or a list.  Every listed code gets a row,
    with 0 when no episode contains it.
    """
    listed = inline_codes(codes)
    if listed is None:
        exposures, rows = _listed_exposures(episodes, codes), codes.select("code").where(F.col("code").isNotNull()).distinct()
    else:
        exposures = exposures_of(episodes).where(is_listed(F.col("code"), listed))
        literals = F.array(*[F.lit(c) for c in sorted(set(listed))]).cast("array<string>")
        rows = episodes.sparkSession.range(1).select(F.explode(literals).alias("code"))
    counts = exposures.groupBy("code").agg(F.count(F.lit(1)).alias("n_excluded"))
    return rows.join(counts, "code", "left").select(
        "code", F.coalesce("n_excluded", F.lit(0)).cast("bigint").alias("n_excluded")
    )


def restrict_codes(episodes: DataFrame, codes) -> DataFrame:
    """Keep only listed codes in each combination (column projection C1/C4).

    Episodes stay even when nothing is left (the reference keeps all-zero
    rows after projecting columns).  A narrow filter for lists that may be
    inlined; longer tables meet the exploded codes in a semi-join, and the
    combinations are gathered again by episode key.
    """
    listed = inline_codes(codes)
    if listed is not None:
        combo = F.filter("combo", lambda c: is_listed(c, listed))
        return episodes.withColumn("combo", combo).withColumn("n_codes", F.size("combo"))
    kept = _listed_exposures(episodes, codes).groupBy(*(F.col(k).alias(f"x_{k}") for k in EPISODE_KEYS))
    kept = kept.agg(F.sort_array(F.collect_set("code")).alias("x_combo"))
    joined = episodes.join(kept, same_episode("x_"), "left")
    combo = F.coalesce("x_combo", F.array().cast("array<string>"))
    out = joined.withColumn("combo", combo).withColumn("n_codes", F.size("combo"))
    return out.select(*episodes.columns)
