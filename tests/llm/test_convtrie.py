"""The conversation trie against dictionaries of all prefixes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyrisk.llm.convtrie import NODES, Excess, graft, prefix_trie, turn_lists

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, key int"


def brute(rows, grafted=True):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest(), (r or "", x or "")))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if grafted else 0
        full[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out = []

    def walk(k):
        """(leaves, savings) of the subtree."""
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves, saved = int(k not in children), (len(members[k]) - 1) * words
        for child in children.get(k, []):
            more = walk(child)
            leaves, saved = leaves + more[0], saved + more[1]
        ends = ",".join(map(str, sorted(c for c in members[k] if len(full[c]) == len(k))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children.get(k, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        walk(())
    return sorted(out, key=str)


def run(spark, rows, grafted=True, **options):
    lists = turn_lists(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4))
    nodes = prefix_trie(graft(lists) if grafted else lists, **options)
    assert nodes.schema.simpleString() == "struct<" + NODES.replace(" ", ":").replace(",:", ",") + ">"
    return sorted((tuple(r) for r in nodes.collect()), key=str)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "a", "é  日本 x", ""])) for t in range(rng.randrange(1, 7))]
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_nodes": 4, "last_paths": 30, "block_ids": 2}])
def test_brute_force(spark, options):
    rows = conversations(1, 130)
    rows += [(500, None, None, None), (500, 2, "user", "late"), (500, 2, "user", "early"), (501, 3, "user", "a b")]  # nulls and ties
    rows += [(None, 1, "user", "no conversation"), (520, 1, "user", "a"), (520, 1, "user", "a")]  # a repeated row
    rows += [(600 + i, t, "user", f"same {t}") for i in range(60) for t in range(3)]  # a hot conversation
    rows += [(700, t, "user", f"word{t} long") for t in range(120)]  # a long one
    rows += [(-7, 0, "user", "negative")] + [(801, 0, "user", "y " * 50_000)]
    assert run(spark, rows, grafted=False, **options) == brute(rows, grafted=False)
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    assert run(spark, rows, **options) == brute(rows)


def test_turnless_and_empty(spark):
    # Conversation 23 has one turn and takes two or more from 20, which does not exist: it ends at the root.
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(lone, 0, "user", "a")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows)[0][:6] == (lone, 0, None, 1, 0, 1)
    assert run(spark, []) == []


def test_findclose():
    rng = random.Random(2)
    for n in (1, 2, 31, 32, 33, 700, 5000):
        opens, depth, left = [], 0, n
        while left or depth:
            up = left and (depth == 0 or rng.random() < (0.9 if n == 700 else 0.5))
            opens.append(bool(up))
            depth, left = depth + (1 if up else -1), left - bool(up)
        stack, want = [], {}
        for i, o in enumerate(opens):
            if o:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opens = np.array([True, *opens, False])  # one root around all
        start = np.flatnonzero(opens)
        got = dict(zip((start - 1).tolist(), (Excess(opens).findclose(start) - 1).tolist()))
        assert got.pop(-1) == len(opens) - 2
        assert got == want


def test_digest_tells_role_from_text(spark):
    rows = spark.createDataFrame([(1, 0, "ab", "c"), (2, 0, "a", "bc")], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie(turn_lists(rows)).where(F.col("depth") == 1).count() == 2
