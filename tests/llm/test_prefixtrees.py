"""Repeated word windows against a brute force over all windows."""

import random
import re

import pytest

from polyrisk.llm.prefixtrees import RepeatedWindows

SCHEMA = "doc_id bigint, text string, n_words string, kept int"


def brute(rows, width):
    """(doc_id, n_words, n_removed, runs, kept) by a dictionary of all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    low = {}
    for (doc_id, *_), w in zip(rows, words):
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            low[key] = min(low.get(key, float("inf")), float("inf") if doc_id is None else doc_id)
    out = []
    for (doc_id, *_), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if low[tuple(w[i : i + width])] < (float("inf") if doc_id is None else doc_id):
                gone[i : i + width] = [True] * width
        starts = [i for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])]
        ends = [i + 1 for i, g in enumerate(gone) if g and (i + 1 == len(gone) or not gone[i + 1])]
        out.append((doc_id, len(w), sum(gone), starts, ends, " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def run(spark, rows, width, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    found = RepeatedWindows(df, width, **options)
    out = sorted((tuple(r) for r in found.texts().collect()), key=str)
    found.release()
    return out


def corpus(seed, n, words, longest=60):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "a", "é", "日本", "x-y", "w1", "w2", "w3"][:words]
    passage = " ".join(rng.choice(vocabulary) for _ in range(25))
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(longest)))
        if i % 3 == 0:
            text = text + rng.choice([" ", "\n", "\t\v "]) + passage + rng.choice(["", " "]) + text[:40]
        rows.append((i, text))
    return rows


@pytest.mark.parametrize(("width", "options"), [(13, {}), (3, {}), (5, {"group_leaves": 20, "plan_step": 1}), (13, {"group_leaves": 2, "plan_step": 1})])
def test_brute_force(spark, width, options):
    rows = corpus(width, 80, 9 if width > 4 else 6)
    rows += [(200, None), (201, ""), (202, " \n "), (7, rows[3][1]), (None, rows[0][1]), (None, rows[0][1]), (-5, rows[6][1]), (300, rows[9][1])]
    rows.append((400, " ".join(f"u{i}" for i in range(30_000)) + " " + rows[0][1]))
    assert run(spark, rows, width, **options) == brute(rows, width)


def test_one_passage_in_every_document(spark):
    """The same window too often for a group: found by the aggregate, not in a subtree."""
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"own{i} {passage} end{i}") for i in range(300)]
    assert run(spark, rows, 13, group_leaves=3, plan_step=1) == brute(rows, 13)


def test_empty_table(spark):
    assert run(spark, [], 13) == []


def test_files_are_deleted(spark):
    found = RepeatedWindows(spark.createDataFrame([(1, "a b c", "", 0)], SCHEMA), 3)
    found.texts().collect()
    found.release()
    assert not spark.catalog.tableExists(found.table)
