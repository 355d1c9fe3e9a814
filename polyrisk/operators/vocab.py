"""Ordered code vocabularies and alignment of episodes to them.

    vocabulary  position INT (1-based), code STRING

Positions come from sorted ranges (``operators.scan``), so a vocabulary may
have any number of codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrisk.operators.contingency import restrict_codes
from polyrisk.operators.episodes import exposures_of
from polyrisk.operators.scan import ranked


def add_prefix(codes: DataFrame, prefix: str = "_", col: str = "code") -> DataFrame:
    """Column-name prefix used by the wide table: C3 (add)."""
    return codes.withColumn(col, F.concat(F.lit(prefix), F.col(col)))


def strip_prefix(codes: DataFrame, col: str = "code", char: str = "_") -> DataFrame:
    """Remove every occurrence of ``char`` (literal, not a regex): C3 (strip) / H1."""
    return codes.withColumn(col, F.replace(F.col(col), F.lit(char), F.lit("")))


def ordered_vocabulary(codes: DataFrame, order_cols: list) -> DataFrame:
    """Number distinct codes 1..m in the given order (ties broken by code)."""
    return ranked(codes, [*order_cols, F.asc("code")], "position", start=1).select("position", "code")


def frequency_vocabulary(episodes: DataFrame) -> DataFrame:
    """All observed codes, most frequent first."""
    counts = exposures_of(episodes).groupBy("code").agg(F.count(F.lit(1)).alias("_n"))
    return ordered_vocabulary(counts, [F.desc("_n")])


def vocab_common(first: DataFrame, second: DataFrame) -> DataFrame:
    """Codes in both vocabularies, in the first one's order: G2."""
    both = first.join(second.select("code"), "code", "left_semi")
    return ordered_vocabulary(both, [F.asc("position")])


def vocab_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """All codes of the first vocabulary, then the second's new codes in its order: G3."""
    extra = second.join(first.select("code"), "code", "left_anti")
    tagged = first.select("code", F.lit(0).alias("_part"), "position").unionByName(
        extra.select("code", F.lit(1).alias("_part"), "position")
    )
    return ordered_vocabulary(tagged, [F.asc("_part"), F.asc("position")])


def vocab_diff(observed: DataFrame, vocab: DataFrame) -> DataFrame:
    """Code-set differences: G4.

    ``missing``: listed but never observed (zero-filled by lenient alignment,
    fatal for strict alignment); ``unknown``: observed but not listed
    (dropped by alignment).
    """
    obs = observed.select("code").distinct()
    voc = vocab.select("code").distinct()
    missing = voc.join(obs, "code", "left_anti").select(F.lit("missing").alias("kind"), "code")
    unknown = obs.join(voc, "code", "left_anti").select(F.lit("unknown").alias("kind"), "code")
    return missing.unionByName(unknown)


def align_lenient(episodes: DataFrame, vocab) -> DataFrame:
    """Lenient alignment: drop unknown codes, keep everything else: C4 (+ C16).

    In long form zero-filling a missing code is implicit (absence is 0) and
    column order is a property of the vocabulary, applied at the wide sink.
    Episodes whose codes are all unknown stay, with an empty combination.
    """
    return restrict_codes(episodes, vocab)


class VocabularyMismatch(ValueError):
    """Raised by strict alignment when listed codes are absent from the data."""


def align_strict(episodes: DataFrame, vocab: DataFrame) -> DataFrame:
    """Strict alignment: C5.  Fails when a listed code never occurs.

    The check is one small anti-join job over per-code tables; the result is
    the lenient alignment once it passes.
    """
    observed = exposures_of(episodes).select("code").distinct()
    missing = vocab.select("code").join(observed, "code", "left_anti")
    first_missing = missing.orderBy("code").take(5)
    if first_missing:
        names = ", ".join(r.code for r in first_missing)
        raise VocabularyMismatch(f"vocabulary codes absent from the data: {names}")
    return align_lenient(episodes, vocab)
