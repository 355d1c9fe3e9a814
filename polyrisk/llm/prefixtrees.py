"""Repeated word windows across documents by prefix-partitioned suffix trees.

Suffixes start at words and are cut at ``width`` words, as deeper nodes are not
asked for.  The steps, each a pass over the chunks of the texts:

1. *Plan.*  Prefixes of 1, about a third, two thirds and all of ``width`` words
   are counted on every 256th word of every document.  A prefix met too often
   for one memory-sized group is extended to the next length; the shortest one
   that is not too frequent is a suffix's prefix.  The plan only deals out work.
2. *Shallow leaves.*  Each window names its smallest short gram; equal windows
   name the same.  A window whose gram occurs in one document is a leaf that
   hangs high up in the tree and leaves the work here.
3. *Subtrees.*  The other suffixes go to the group of their prefix.  A group is
   sorted by the path from the root (hashes of the prefixes at the depths of
   the plan); the common prefixes of neighbours give the internal nodes, and
   those ``width`` words deep are repeats.  The smallest document below each
   such node is compared with each leaf, and one bit goes back to its text.
   Suffixes that share all their words more often than a group can hold are one
   deep node in themselves: an aggregate gives its smallest document.

A chunk sends one leaf for each distinct window, with its smallest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrisk.llm import hashing as H
from polyrisk.llm.chunked import MARK_ROWS, bits_of, chunk_table, drop_table, map_chunks, parts_of
from polyrisk.llm.common import materialise, release

GRAM, LEAF = 0, 1
PLAN_STEP = 256
#: Leaves of a group (more only where the corpus would need over a million groups).
GROUP_LEAVES = 250_000
#: Rows without an id come after all ids.
NO_ID = np.iinfo(np.int64).max


def depths(width: int) -> list[int]:
    """The prefix lengths of the plan and of the path: 1, 5, 9, 13 for 13 words."""
    return sorted({1, -(-width // 3), -(-2 * width // 3), width})


class Words:
    """The words of a chunk and the hashes of their windows."""

    def __init__(self, row: dict, width: int):
        self.width, self.buf = width, row["data"]
        self.offsets = np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)
        self.ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
        self.starts, self.ends = H.word_spans(self.buf, self.offsets)
        self.bounds = np.searchsorted(self.starts, self.offsets)
        hashes = H.window_hashes(H.prefix_sums(self.buf), self.starts, self.ends)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * H.powers(len(hashes) + 1, H.BASE2)[0][: len(hashes)], out=self.sums[1:])
        counts = np.maximum(np.diff(self.bounds) - width + 1, 0)
        self.owner = np.repeat(np.arange(len(counts)), counts)
        #: First words of the windows.
        self.at = np.arange(len(self.owner)) + np.repeat(self.bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        self.doc = self.ids[self.owner]

    def prefix(self, at: np.ndarray, n: int) -> np.ndarray:
        return H.window_hashes(self.sums, at, at + n, H.BASE2)

    def grams(self) -> np.ndarray:
        """The smallest gram hash of each window."""
        size = depths(self.width)[1]
        count = len(self.starts) - size + 1
        if not len(self.at):
            return np.zeros(0, np.uint64)
        least, have, want = self.prefix(np.arange(count), size), 1, self.width - size + 1
        while have < want:
            step = min(have, want - have)
            least, have = np.minimum(least[: len(least) - step], least[step:]), have + step
        return least[self.at]


class Plan:
    """Which group a suffix goes to; the same on every worker."""

    def __init__(self, width: int, groups: int, often: dict[int, np.ndarray]):
        self.width, self.groups, self.often = width, groups, often

    def deal(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.groups) >> np.uint64(32)).astype(np.int64)

    def is_often(self, depth: int, hashes: np.ndarray) -> np.ndarray:
        known = self.often.get(depth)
        if known is None or not len(known):
            return np.zeros(len(hashes), bool)
        return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes

    def group(self, words: Words, at: np.ndarray) -> np.ndarray:
        """The group of the shortest prefix that is not too frequent, or -1."""
        group, left = np.full(len(at), -1), np.arange(len(at))
        for depth in depths(self.width):
            hashes = words.prefix(at[left], depth)
            more = self.is_often(depth, hashes)
            group[left[~more]] = self.deal(hashes[~more])
            left = left[more]
        return group

    def grams(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct grams, each window's place among them, too frequent ones, parts)."""
        keys, inverse = np.unique(words.grams(), return_inverse=True)
        often = self.is_often(GRAM, keys)
        return keys, inverse, often, np.where(often, -1, self.deal(keys))


class Leaves:
    """The distinct windows of a chunk that may repeat, and their smallest documents."""

    def __init__(self, row: dict, plan: Plan, words: Words):
        _, inverse, often, part = plan.grams(words)
        open_ = (bits_of(row, GRAM, part) | often)[inverse]
        self.windows = np.flatnonzero(open_)
        at = words.at[self.windows]
        keys, first, self.leaf = np.unique(words.prefix(at, plan.width), return_index=True, return_inverse=True)
        self.at = at[first]
        self.doc = np.full(len(keys), NO_ID)
        np.minimum.at(self.doc, self.leaf, words.doc[self.windows])
        self.group = plan.group(words, self.at)
        low, mid = (words.prefix(self.at, d) >> np.uint64(32) for d in depths(plan.width)[1:3])
        self.path, self.full = low << np.uint64(32) | mid, keys


def _grams(rows: pd.DataFrame) -> pd.DataFrame:
    """Mark the grams of a part that stand in more than one document."""
    counts = rows["n"].to_numpy()
    keys = np.frombuffer(b"".join(rows["keys"]), "<u8")
    flags = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(rows["flags"], counts, strict=True)])
    _, inverse, met = np.unique(keys, return_inverse=True, return_counts=True)
    hit = (met > 1) | (np.bincount(inverse, flags) > 0)
    return _bits(rows, hit[inverse])


def _subtrees(rows: pd.DataFrame) -> pd.DataFrame:
    """Sort a group's leaves by path; mark leaves below a deep node with a smaller document."""
    path, full, doc = (np.frombuffer(b"".join(rows[c]), t) for c, t in (("path", "<u8"), ("full", "<u8"), ("doc", "<i8")))
    order = np.lexsort((full, path))
    # Common prefixes of neighbours: a deep node is a run of equal paths to its full depth.
    deep = (path[order][1:] == path[order][:-1]) & (full[order][1:] == full[order][:-1])
    node = np.cumsum(np.concatenate([[0], ~deep])) if len(order) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], ~deep]))
    least = np.minimum.reduceat(doc[order], first)
    hit = np.zeros(len(doc), bool)
    hit[order] = least[node] < doc[order]
    return _bits(rows, hit)


def _bits(rows: pd.DataFrame, hit: np.ndarray) -> pd.DataFrame:
    ends = np.cumsum(rows["n"].to_numpy())
    parts = [hit[e - n : e] for e, n in zip(ends, rows["n"], strict=True)]
    out = rows[["chunk", "kind", "part", "n"]].copy()
    out["bits"] = [np.packbits(p).tobytes() for p in parts]
    return out[[bool(p.any()) for p in parts]]


class RepeatedWindows:
    """The rounds over the texts of ``docs``; :meth:`texts` reads their files until :meth:`release`.

    Words are runs other than ASCII white space, unchanged.  Each word covered
    by a window of ``width`` words that also starts in a document with a smaller
    id is removed; windows lie in one document and are judged on the input.

    Null texts have no words.  Rows are documents: rows that repeat an id lose
    nothing to each other; a row without an id comes after all ids (and loses
    nothing to another such row).  An empty table gives an empty result; other
    columns are ignored.  Equality is of 128 hash bits.
    """

    def __init__(self, docs: DataFrame, width: int = 13, group_leaves: int = GROUP_LEAVES, id_col: str = "doc_id", text_col: str = "text", plan_step: int = PLAN_STEP):
        if width < 3:
            raise ValueError("width is 3 or more")
        self.spark, self.width = docs.sparkSession, width
        self.table = chunk_table(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "prefix_trees")
        self.chunks, self.files = self.spark.table(self.table), []
        plan = self._plan(group_leaves, plan_step)
        self.plan = self.spark.sparkContext.broadcast(plan)
        self.marks = self._keep(self._shallow(), "prefix-marks")
        leaves = self._leaves()
        self.least = None
        if len(plan.often.get(width, [])):
            leaves = self._keep(leaves, "prefix-leaves")
            self.least = _smallest(leaves.where("part < 0"))
        trees = leaves.where("part >= 0").groupBy("part").applyInPandas(_subtrees, MARK_ROWS)
        self.marks = self.marks.unionByName(self._keep(trees, "prefix-marks"))

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        self.files.append(materialise(df, name))
        return self.files[-1]

    def release(self) -> None:
        """Delete the chunk table and the marks."""
        drop_table(self.spark, self.table)
        for df in self.files:
            release(df)

    def _plan(self, group_leaves: int, step: int) -> Plan:
        width = self.width

        def sampled(row: dict) -> Iterator[tuple]:
            words = Words(row, width)
            every = (words.at + row["chunk"]) % step == 0
            for depth in [GRAM, *depths(width)]:
                hashes = words.prefix(words.at[every], depth) if depth else words.grams()[every]
                for key, n in zip(*np.unique(hashes, return_counts=True), strict=True):
                    yield depth, int(key.view(np.int64)), int(n)
            yield -1, 0, len(words.at)

        counted = materialise(map_chunks(self.chunks, None, "depth int, key bigint, n bigint", sampled).groupBy("depth", "key").agg(F.sum("n").alias("n")), "prefix-plan")
        total = counted.where("depth = -1").agg(F.sum("n")).first()[0] or 0
        load = max(group_leaves, -(-total // 1_000_000))
        # At most 2 * total / load prefixes of a length are so frequent, two million for the largest corpus.
        frequent = counted.where((F.col("depth") >= 0) & (F.col("n") * step > load // 2)).toPandas()
        release(counted)
        often = {int(d): np.sort(g["key"].to_numpy(np.int64).view(np.uint64)) for d, g in frequent.groupby("depth")}
        return Plan(width, max(1, -(-total // (2 * load))), often)

    def _shallow(self) -> DataFrame:
        """Marks of the grams that stand in several documents."""
        plan, width = self.plan, self.width

        def grams(row: dict) -> Iterator[tuple]:
            words = Words(row, width)
            keys, inverse, _, part = plan.value.grams(words)
            # A gram is repeated here if its windows lie in more than one document.
            low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), -1)
            np.minimum.at(low, inverse, words.owner)
            np.maximum.at(high, inverse, words.owner)
            for p, at in parts_of(part):
                if p >= 0:
                    yield p, GRAM, row["chunk"], len(at), keys[at].tobytes(), np.packbits((low < high)[at]).tobytes()

        sent = map_chunks(self.chunks, None, "part int, kind int, chunk bigint, n int, keys binary, flags binary", grams)
        return sent.groupBy("part").applyInPandas(_grams, MARK_ROWS)

    def _leaves(self) -> DataFrame:
        plan, width = self.plan, self.width

        def leaves(row: dict) -> Iterator[tuple]:
            found = Leaves(row, plan.value, Words(row, width))
            for p, at in parts_of(found.group):
                yield p, LEAF, row["chunk"], len(at), found.path[at].tobytes(), found.full[at].tobytes(), found.doc[at].tobytes()

        return map_chunks(self.chunks, self.marks, "part int, kind int, chunk bigint, n int, path binary, full binary, doc binary", leaves)

    def texts(self) -> DataFrame:
        """(doc_id, n_words, n_removed, starts, ends, kept) for every document.

        ``starts`` and ``ends`` bound the removed runs of words (from 0, end
        exclusive), ``kept`` has the other words joined by one space.
        """
        plan, width, least = self.plan, self.width, self.spark.sparkContext.broadcast(self.least)

        def result(row: dict) -> Iterator[tuple]:
            words = Words(row, width)
            found = Leaves(row, plan.value, words)
            hit = bits_of(row, LEAF, found.group)
            if least.value is not None:
                known, smallest = least.value
                place = np.minimum(np.searchsorted(known, found.full), len(known) - 1)
                hit |= (found.group < 0) & (known[place] == found.full) & (smallest[place] < found.doc)
            gone = hit[found.leaf] | (words.doc[found.windows] > found.doc[found.leaf])
            yield from _texts(row, words, words.at[found.windows[gone]])

        return map_chunks(self.chunks, self.marks, "doc_id bigint, n_words bigint, n_removed bigint, starts array<int>, ends array<int>, kept string", result)


def _smallest(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys, smallest documents) of the windows too frequent for a group; bounded as the plan is."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"full": np.frombuffer(b"".join(pdf["full"]), "<i8"), "doc": np.frombuffer(b"".join(pdf["doc"]), "<i8")})

    found = rows.select("full", "doc").mapInPandas(unpack, "full bigint, doc bigint").groupBy("full").agg(F.min("doc").alias("doc")).toPandas()
    keys = found["full"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["doc"].to_numpy(np.int64)[order]


def _texts(row: dict, words: Words, starts: np.ndarray) -> Iterator[tuple]:
    """A result row for each document, given the first words of the windows that go."""
    steps = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + words.width, -1)
    gone = np.cumsum(steps)[:-1] > 0
    doc_of = np.searchsorted(words.bounds, np.arange(len(gone)), side="right") - 1
    kept = np.flatnonzero(~gone)
    # A kept word keeps the white space after it, as a blank, unless it is its document's last.
    ends = words.ends[kept] + np.concatenate([doc_of[kept][1:] == doc_of[kept][:-1], [False]])[: len(kept)]
    cover = np.zeros(len(words.buf) + 1, np.int64)
    cover[words.starts[kept]] += 1
    np.add.at(cover, ends, -1)
    take = np.cumsum(cover)[:-1] > 0
    clean = np.where(H.SPACE[words.buf], np.uint8(32), words.buf)[take]
    cuts = np.concatenate([[0], np.cumsum(take)])[words.offsets]
    for k, doc_id in enumerate(row["ids"]):
        lo, hi = words.bounds[k], words.bounds[k + 1]
        edge = np.diff(np.concatenate([[0], gone[lo:hi].astype(np.int8), [0]]))
        yield doc_id, int(hi - lo), int(gone[lo:hi].sum()), np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), clean[cuts[k] : cuts[k + 1]].tobytes().decode()
