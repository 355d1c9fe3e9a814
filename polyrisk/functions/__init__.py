"""Column expressions shared by the operators (all JVM-side built-ins)."""

from polyrisk.functions.expr import (
    bce_terms,
    combo_from_text,
    combo_identity,
    combo_key,
    hash_unit,
    penalised_bce_terms,
    ratio,
    round_half_even,
    unit_threshold,
)

__all__ = [
    "bce_terms",
    "combo_from_text",
    "combo_identity",
    "combo_key",
    "hash_unit",
    "penalised_bce_terms",
    "ratio",
    "round_half_even",
    "unit_threshold",
]
