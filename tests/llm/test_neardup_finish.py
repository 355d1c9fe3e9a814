"""The exact finish of near-duplicate groups against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from polyrisk.llm import neardup as N


def _grown_sets(seed: int, count: int) -> list[np.ndarray]:
    """Sets of very different sizes, most of them changed copies of a few others."""
    rng = np.random.default_rng(seed)
    bases = [rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for n in (1, 3, 12, 60, 150)]
    common = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    found = []
    for i in range(count):
        base = bases[i % len(bases)]
        kept = base[rng.random(len(base)) > rng.choice([0, 0.02, 0.1, 0.3])]
        added = rng.integers(0, 1 << 63, rng.integers(0, 1 + len(base) // 4), dtype=np.uint64)
        parts = [kept, added] + ([common] if i % 3 == 0 else [])
        found.append(np.unique(np.concatenate(parts)))
    return [s for s in found if len(s)]


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_prefix_pairs_hold_every_pair(spark, percent):
    sets = _grown_sets(percent, 160)
    names = [i.to_bytes(16, "big") for i in range(len(sets))]
    roots = [(i // 4 * 4).to_bytes(16, "big") for i in range(len(sets))]
    minor = [i % 2 == 0 for i in range(len(sets))]
    rows = [(names[i], s.tobytes(), roots[i], minor[i]) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "cls binary, items binary, root binary, minor boolean")
    found = [tuple(sorted((bytes(r.a), bytes(r.b)))) for r in N.prefix_pairs(table, percent).collect()]
    assert len(found) == len(set(found))
    wanted = set()
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(x, sets[j]))
            if 100 * both >= percent * (len(x) + len(sets[j]) - both) and roots[i] != roots[j] and (minor[i] or minor[j]):
                wanted.add(tuple(sorted((names[i], names[j]))))
    assert wanted and wanted <= set(found)


def test_a_common_passage_makes_few_candidates(spark):
    """Sets that share 60 of 160 shingles are no candidates at 0.8, however many hold them."""
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    rows = [(i.to_bytes(16, "big"), np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 100, dtype=np.uint64)])).tobytes(), i.to_bytes(16, "big"), True) for i in range(300)]
    table = spark.createDataFrame(rows, "cls binary, items binary, root binary, minor boolean")
    assert N.prefix_pairs(table, 80).count() < 300


def test_repeated_groups_of_one_bucket(spark):
    """Near copies of two texts, an empty and a null text: components by all pairs of word shingles."""
    rng = np.random.default_rng(5)
    bases = [[f"w{k}" for k in rng.integers(0, 4000, 80)] for _ in range(2)]
    texts: list[str | None] = ["", None]
    for i in range(120):
        words = list(bases[i % 2])
        words[int(rng.integers(0, 80))] = f"x{i}" if i % 5 else f"y{i % 3}"
        if i % 7 == 0:
            words[int(rng.integers(0, 80))] = f"z{i}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs).collect()}
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in ((t or "").split() for t in texts)]
    low = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((low[i], low[j]))
                low = [a if x == b else x for x in low]
    assert got == dict(enumerate(low))
