"""Cleaning and statistics chain (the reference's first entry point).

    episodes -> non-empty -> code statistics -> three-way screen
             -> exclude episodes exposed to 'removed' codes (counts on input)
             -> exclude episodes exposed to 'end' codes (counts on survivors)
             -> project combinations to 'kept' codes

Order matters: the second set of counts is taken over the survivors of the
first exclusion.  The screen's three code lists are fetched once and enter
the episode filters as IN lists, so the exclusions scan the episode table and
never shuffle it; longer lists than may be inlined are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrisk.operators.contingency import (
    SCREEN_END,
    SCREEN_KEPT,
    SCREEN_REMOVED,
    code_contingency,
    codes_in,
    exclude_exposed,
    exclusion_counts,
    fetch_screen_code_sets,
    restrict_codes,
    screen_codes,
)
from polyrisk.operators.episodes import non_empty


@dataclass
class ScreeningResult:
    code_stats: DataFrame
    screen: DataFrame
    removed_counts: DataFrame
    after_removed: DataFrame
    end_counts: DataFrame
    after_end: DataFrame
    cleaned: DataFrame

    def kept(self) -> DataFrame:
        return codes_in(self.screen, SCREEN_KEPT)

    def excluded_counts(self) -> DataFrame:
        """Both exclusion steps as one table (step 1 = removed, 2 = end)."""
        first = self.removed_counts.select(F.lit(1).alias("step"), "code", "n_excluded")
        second = self.end_counts.select(F.lit(2).alias("step"), "code", "n_excluded")
        return first.unionByName(second)


def run_screening(episodes: DataFrame, thres: int = 0) -> ScreeningResult:
    """The whole chain; the three code lists are fetched once, in one small job."""
    base = non_empty(episodes)
    stats = code_contingency(base, require_non_empty=False)
    screen = screen_codes(stats, thres)
    sets = fetch_screen_code_sets(screen)
    removed, end, kept = sets[SCREEN_REMOVED], sets[SCREEN_END], sets[SCREEN_KEPT]
    removed_counts = exclusion_counts(base, removed)
    after_removed = exclude_exposed(base, removed)
    end_counts = exclusion_counts(after_removed, end)
    after_end = exclude_exposed(after_removed, end)
    cleaned = restrict_codes(after_end, kept)
    return ScreeningResult(stats, screen, removed_counts, after_removed, end_counts, after_end, cleaned)
