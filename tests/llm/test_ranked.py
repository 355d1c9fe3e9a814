"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from polyrisk.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    found = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in found), sum(len(w) for _, w in found)
    df = Counter(t for _, w in found for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for i, w in found:
            counts, score = Counter(w), 0
            for t in set(TERM.findall((text or "").translate(LOWER))):
                if counts[t]:
                    m = 100 - 90 + (90 * len(w) * n_docs) // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "Of", "é", "É", "日本", "x1", "a_b", *(f"w{i}" for i in range(30))]
    weights = [40, 20, 20, 5, 5, 5, 5, 5, *range(30, 0, -1)]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, weights, k=rng.randrange(40)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 25)))) for i in range(12)]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shard_docs": 16, "block_bytes": 200}])
def test_brute_force(spark, options):
    docs, items = corpus(4, 160)
    docs += [(3, docs[3][1]), (3, docs[8][1]), (None, docs[5][1]), (None, None), (900, None), (901, "... !"), (902, ""), (-4, docs[7][1])]
    docs += [(1000 + i, "same text of copies w3") for i in range(40)] + [(2000, "the w1 " * 20_000)]
    items += [(0, items[0][1]), (0, "w3"), (None, "w5 w6"), (50, None), (51, ""), (52, "unknownterm"), (53, "the " * 5000 + "w2")]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, item int, terms string").repartition(3)
    asked = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id bigint, text string, rank int, score int")
    got = sorted((tuple(r) for r in ranked.rank(table, asked, k=5, **options).collect()), key=str)
    assert got == brute(docs, items, 5)


def test_empty_tables(spark):
    docs, items = corpus(1, 10)
    none = lambda c: spark.createDataFrame([], f"{c} bigint, text string")
    some = lambda c, rows: spark.createDataFrame(rows, f"{c} bigint, text string")
    assert ranked.rank(none("doc_id"), some("item_id", items)).count() == 0
    assert ranked.rank(some("doc_id", docs), none("item_id")).count() == 0
    assert ranked.rank(some("doc_id", [(1, "!"), (2, None)]), some("item_id", items)).count() == 0


@pytest.mark.parametrize("short", [0, 3, 50])
def test_intervals_are_split_and_pruned(monkeypatch, short):
    """One shard searched without the short cut; rare terms leave most documents unseen."""
    monkeypatch.setattr(ranked, "SHORT", short)
    rng = np.random.default_rng(short)
    n, size = 2000, 12
    held = rng.random((size, n)) < np.linspace(0.01, 0.5, size)[:, None]
    term, doc = np.nonzero(held)
    tf = rng.integers(1, 4, len(term))
    lengths = rng.integers(20, 200, n)
    row = {"ids": np.arange(n).astype(np.int64).tobytes(), "named": n, "lengths": lengths.astype(np.int64).tobytes(), "terms": term.astype(np.int32).tobytes(), "docs": doc.astype(np.int32).tobytes(), "counts": tf.astype(np.int32).tobytes()}
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(c) + 1))) for c in held.sum(axis=1)])
    lists = ranked.Postings(row, weights, n, int(lengths.sum()))
    scores = np.zeros(n, np.int64)
    np.add.at(scores, doc, lists.impact)
    seen, real = [], lists.maxima
    lists.maxima = lambda lo, hi: (seen.append(1), real(lo, hi))[1]
    best: list = []
    lists.search(np.arange(size), best, 10)
    assert sorted(best, reverse=True) == sorted(((int(s), -i) for i, s in enumerate(scores)), reverse=True)[:10]
    assert len(seen) < 0.9 * 2 * n


def test_range_maxima():
    rng = np.random.default_rng(1)
    row = {"ids": np.arange(300).tobytes(), "named": 300, "lengths": np.full(300, 9).tobytes(), "terms": np.zeros(300, np.int32).tobytes(), "docs": np.arange(300, dtype=np.int32).tobytes(), "counts": rng.integers(1, 50, 300).astype(np.int32).tobytes()}
    lists = ranked.Postings(row, np.array([700]), 300, 2700)
    lo, hi = np.array([(i, j) for i in range(0, 300, 7) for j in range(i + 1, 301, 3)]).T
    assert (lists.impact[lists.maxima(lo, hi)] == [lists.impact[i:j].max() for i, j in zip(lo, hi)]).all()
