"""Scalar building blocks.

Every helper returns a Column made of Spark built-ins so that it stays inside
whole-stage code generation.  Where an oracle must reproduce a value bit for
bit (hash buckets, ratios) the expression is chosen so DuckDB can compute the
same thing; the twin is documented next to each helper.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**32: hash buckets are the first 32 bits of an md5 digest.
HASH_SPACE = 4294967296.0

# Natural-log floor used by binary cross-entropy (public BCELoss rule).
LOG_FLOOR = -100.0


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def combo_key(combo: str | Column, sep: str = "|") -> Column:
    """Sorted code array -> one printable key; '' for the empty combination.

    DuckDB twin: ``coalesce(string_agg(DISTINCT code, '|' ORDER BY code), '')``.
    """
    return F.array_join(_col(combo), sep)


def combo_identity(combo: str | Column) -> Column:
    """A text that names a code array: no two arrays share it, whatever their codes hold.

    Equal to :func:`combo_key` where no code is null or empty or holds ``|`` or
    a backslash (its DuckDB twin then holds too).
    """
    escaped = F.transform(
        _col(combo),
        lambda c: F.when(c.isNull(), F.lit("\\n")).when(c == "", F.lit("\\e")).otherwise(
            F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))
        ),
    )
    return F.array_join(escaped, "|")


def combo_from_text(text: str | Column) -> Column:
    """The code array that :func:`combo_identity` wrote as ``text``."""

    def code(c: Column) -> Column:
        # Between escaped backslashes, the only backslash left is that of an escaped bar.
        plain = F.transform(F.split(c, r"\\\\"), lambda x: F.replace(x, F.lit("\\p"), F.lit("|")))
        return F.when(c == "\\n", F.lit(None)).when(c == "\\e", F.lit("")).otherwise(F.array_join(plain, "\\"))

    none = F.array().cast("array<string>")
    return F.when(_col(text) == "", none).otherwise(F.transform(F.split(_col(text), r"\|"), code))


def hash_unit(seed: int, key: str | Column) -> Column:
    """Deterministic bucket in [0, 2**32) of ``key`` under ``seed``.

    Reproducible across engines, unlike ``rand``/``sample``:
    DuckDB twin: ``('0x' || substr(md5('<seed>|' || key), 1, 8))::BIGINT``.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), _col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def unit_threshold(fraction: float) -> float:
    """Hash value below which a key is selected with probability ``fraction``."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"fraction must be in [0, 1], got {fraction}")
    return fraction * HASH_SPACE


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """numerator / denominator as double; NULL when the denominator is 0.

    NULL (not NaN) keeps undecidable rows out of every comparison, as the
    reference's NaN did; Spark treats NaN as the largest value, which would not.
    """
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def round_half_even(c: str | Column, scale: int = 2) -> Column:
    """Banker's rounding, matching pandas ``round`` (DuckDB: ``round_even``)."""
    return F.bround(_col(c), scale)


def safe_log(p: str | Column) -> Column:
    """ln(p) floored at -100; ln(0) (NULL in Spark) also maps to the floor."""
    return F.coalesce(F.greatest(F.log(_col(p)), F.lit(LOG_FLOOR)), F.lit(LOG_FLOOR))


def bce_terms(n: str | Column, n_pos: str | Column, p: str | Column) -> Column:
    """Summed binary cross-entropy of ``n`` rows, ``n_pos`` of them positive,
    all predicted with probability ``p``.  Divide the sum by total rows for
    the mean loss.  Zero-count terms contribute 0 even at the log floor.
    """
    n_c, pos_c, p_c = _col(n), _col(n_pos), _col(p)
    return -(pos_c * safe_log(p_c) + (n_c - pos_c) * safe_log(F.lit(1.0) - p_c))


# Offset inside the logs of the penalised loss (reference's compute_loss).
PENALTY_LOG_OFFSET = 1e-7


def penalised_bce_terms(n, n_pos, p, weight=1.0) -> Column:
    """Summed penalised BCE: -(w * y * ln(p + 1e-7) + (1 - y) * ln(1 - p + 1e-7)).

    Defined by the reference's penalty models but never used for training
    there (their penalties stay 1); exposed as an aggregate term.
    """
    n_c, pos_c, p_c = _col(n), _col(n_pos), _col(p)
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    off = F.lit(PENALTY_LOG_OFFSET)
    return -(w * pos_c * F.log(p_c + off) + (n_c - pos_c) * F.log(F.lit(1.0) - p_c + off))
