"""Prefix trie of conversations in balanced parentheses, one part of it per shard.

A turn is its digest (md5 of role and text) and a conversation the text of its
turns' digests; sorted, these texts list the trie's leaves in order.  Shards are
ranges of that order, and each shard writes its part of the trie as balanced
parentheses in preorder:

* blocks of excess values with their minima and maxima answer *findclose*, so
  the subtree of a node is the stretch from its parenthesis to the closing one;
* the rank of leaf pairs ``()`` at both ends counts leaves;
* cumulative arrays over the preorder give members and savings of a subtree.

Only nodes on the first and last path of a shard (its spines) can have members
elsewhere.  A shard gives those two paths on, each node with what hangs off it,
and they are the paths of the next, much smaller trie, until one shard is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrisk.llm.common import materialise, release

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of a turn's digest.
TURN = 32
#: A shard ends at so many nodes, and the last one is made of so many paths.
SHARD_NODES = 500_000
LAST_PATHS = 20_000
#: Ids whose text makes one block of a conversation's member list.
BLOCK_IDS = 100_000
NONE = np.iinfo(np.int64).max
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
BLOCK = 64


class Excess:
    """Excess of a parenthesis sequence in blocks, each with its least and largest value."""

    def __init__(self, opens: np.ndarray):
        self.values = np.cumsum(np.where(opens, 1, -1))
        padding = np.full(-len(opens) % BLOCK, self.values[-1])
        blocks = np.concatenate([self.values, padding]).reshape(-1, BLOCK)
        # A tree over the blocks, level by level in one array: node i of a level lies over nodes 2i and 2i + 1.
        least, most = [blocks.min(axis=1)], [blocks.max(axis=1)]
        while len(least[-1]) > 1:
            for levels, pick in ((least, np.minimum), (most, np.maximum)):
                even = np.concatenate([levels[-1], levels[-1][len(levels[-1]) // 2 * 2 :][-1:]])
                levels[-1] = even
                levels.append(pick(even[::2], even[1::2]))
        self.base = np.concatenate([[0], np.cumsum([len(x) for x in least])])
        self.least, self.most = np.concatenate(least), np.concatenate(most)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The parenthesis that closes each opening one: the next place with one less excess."""
        goal, size = self.values[at] - 1, len(self.values)
        found = self._scan(at + 1, np.minimum((at // BLOCK + 1) * BLOCK, size), goal)
        left = np.flatnonzero(found < 0)
        block = self._next_block(at[left] // BLOCK + 1, goal[left])
        found[left] = self._scan(block * BLOCK, np.minimum((block + 1) * BLOCK, size), goal[left])
        return found

    def _scan(self, start: np.ndarray, stop: np.ndarray, goal: np.ndarray) -> np.ndarray:
        found, place = np.full(len(start), -1), start.copy()
        todo = np.flatnonzero(place < stop)
        while len(todo):
            hit = self.values[place[todo]] == goal[todo]
            found[todo[hit]] = place[todo[hit]]
            todo = todo[~hit]
            place[todo] += 1
            todo = todo[place[todo] < stop[todo]]
        return found

    def _next_block(self, block: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """The first block from ``block`` on whose values reach the goal (there is one)."""
        node, level = block.copy(), np.zeros(len(block), np.int64)
        holds = lambda q: (self.least[self.base[level[q]] + node[q]] <= goal[q]) & (goal[q] <= self.most[self.base[level[q]] + node[q]])
        todo = np.arange(len(block))
        while len(todo):
            todo = todo[~holds(todo)]
            node[todo] += 1
            up = todo[node[todo] % 2 == 0]
            node[up] //= 2
            level[up] += 1
        todo = np.flatnonzero(level)
        while len(todo):
            level[todo] -= 1
            node[todo] *= 2
            node[todo[~holds(todo)]] += 1
            todo = todo[level[todo] > 0]
        return node


class Path:
    """A conversation, or a spine: the turns' digests and what belongs to each of its nodes.

    ``own`` has a row for each depth from 0 and the columns members that end
    there, smallest id, and members, children, leaves and savings that hang off
    the node outside of the trie at hand.
    """

    def __init__(self, seq: str, words: np.ndarray, own: np.ndarray, ends: dict[int, str]):
        self.seq, self.words, self.own, self.ends = seq.encode(), words, own, ends
        self.size = len(words)

    @classmethod
    def of(cls, row: dict) -> Path:
        words = np.array(row["words"], np.int64)
        if row["own"] is not None:
            return cls(row["seq"], words, np.frombuffer(row["own"], np.int64).reshape(-1, 6), dict(zip(row["depths"], row["shas"], strict=True)))
        own = np.zeros((len(words) + 1, 6), np.int64)
        own[:, LOW] = NONE
        own[-1, :2] = row["n"], row["low"]
        return cls(row["seq"], words, own, {len(words): row["sha"]})

    def keys(self) -> list[str]:
        """The key of each of its nodes, from the root on."""
        md5, out = hashlib.md5(), []
        for i in range(self.size + 1):
            out.append(md5.hexdigest())
            md5.update(self.seq[i * TURN : (i + 1) * TURN])
        return out

    def shared(self, other: Path) -> int:
        """Turns at the start that both have."""
        n = min(self.size, other.size) * TURN
        differ = np.frombuffer(self.seq, np.uint8, n) != np.frombuffer(other.seq, np.uint8, n)
        return int(differ.argmax()) // TURN if differ.any() else n // TURN


ENDS, LOW, CONVS, CHILDREN, LEAVES, SAVED = range(6)


class Shard:
    """The trie of sorted paths, its nodes numbered in preorder.

    ``named`` gives every node a key (the md5 of its path); otherwise only the
    nodes of the first and last path, the spines, get theirs.
    """

    def __init__(self, paths: list[Path], named: bool):
        common = np.array([0] + [b.shared(a) for a, b in zip(paths, paths[1:], strict=False)])
        deep = np.array([p.size for p in paths])
        # The root opens; then each path closes what it leaves and opens its own nodes.
        steps, kind = np.empty(2 * len(paths) + 1, np.int64), np.zeros(2 * len(paths) + 1, bool)
        steps[::2] = np.concatenate([[1], deep[:-1] - common[1:], [deep[-1] + 1]])
        steps[1::2], kind[1::2], kind[0] = deep - common, True, True
        self.opens = np.repeat(kind, steps)
        count = int(self.opens.sum())
        self.parent, self.words, self.own = np.full(count, -1), np.zeros(count, np.int64), np.zeros((count, 6), np.int64)
        self.own[:, LOW] = NONE
        self.ends: dict[int, str] = {}
        self.keys: dict[int, str] = {}
        at, made, spines = np.zeros(int(deep.max()) + 1, np.int64), 1, []
        for i, (path, shared) in enumerate(zip(paths, common.tolist(), strict=True)):
            new = np.arange(made, made + path.size - shared)
            self.parent[new] = np.concatenate([at[shared : shared + 1], new[:-1]])[: len(new)]
            at[shared + 1 : path.size + 1] = new
            self.words[new] = path.words[shared:]
            made += len(new)
            nodes = at[: path.size + 1].copy()
            low = np.minimum(self.own[nodes, LOW], path.own[:, LOW])
            self.own[nodes] += path.own
            self.own[nodes, LOW] = low
            self.ends.update({int(nodes[d]): sha for d, sha in path.ends.items()})
            if i in (0, len(paths) - 1):
                spines.append((path, nodes))
            if named or i in (0, len(paths) - 1):
                self.keys.update(zip(nodes.tolist(), path.keys(), strict=True))
        self.spines = spines
        self._totals()

    def _totals(self) -> None:
        excess = Excess(self.opens)
        start = np.flatnonzero(self.opens)
        close = excess.findclose(start)
        self.depth = excess.values[start] - 1
        first = np.arange(len(start))
        last = first + (close - start + 1) // 2  # one past the subtree's last node
        over = lambda x: np.concatenate([[0], np.cumsum(x)])
        within = lambda x: over(x)[last] - over(x)[first]
        self.convs = within(self.own[:, ENDS] + self.own[:, CONVS])
        # Leaf pairs "()", unless something hangs off the node outside of this trie.
        pairs = self.opens & ~np.concatenate([self.opens[1:], [True]])
        pairs[start] &= self.own[:, CHILDREN] == 0
        rank = over(pairs)
        self.leaves = rank[close] - rank[start] + within(self.own[:, LEAVES])
        self.children = np.bincount(self.parent[1:], minlength=len(start)) + self.own[:, CHILDREN]
        self.saved = within((self.convs - 1) * self.words + self.own[:, SAVED])
        self.low = _range_least(self.own[:, LOW], first, last)

    def rows(self, whole: bool) -> Iterator[pa.RecordBatch]:
        """The nodes that lie in this shard alone, and its spines (all nodes if it is the whole trie)."""
        spine = np.zeros(len(self.parent), bool)
        for _, nodes in self.spines:
            spine[nodes] = not whole
        at = np.flatnonzero(~spine)
        up = self.parent[at]
        away = (up >= 0) & spine[up]
        columns = {
            "conv_id": self.low[at], "depth": self.depth[at], "parent_conv_id": pa.array(self.low[up], mask=(up < 0) | away),
            "parent_key": [self.keys[p] if a else None for p, a in zip(up.tolist(), away.tolist(), strict=True)], "key": [self.keys.get(v) for v in at.tolist()],
            "n_convs": self.convs[at], "n_children": self.children[at], "n_leaves": self.leaves[at], "saved_tokens": self.saved[at],
            "ends_sha256": [self.ends.get(v, NO_MEMBERS) for v in at.tolist()],
        }
        yield _batch(columns)
        if not whole:
            yield self._spine_rows(spine)

    def _spine_rows(self, spine: np.ndarray) -> pa.RecordBatch:
        """The spines as paths; what hangs off a node is added to its own values, once."""
        own, hung = self.own.copy(), np.flatnonzero(~spine)
        hung = hung[spine[self.parent[hung]]]
        up = self.parent[hung]
        for column, values in ((CONVS, self.convs), (LEAVES, self.leaves), (SAVED, self.saved), (CHILDREN, np.ones(len(spine), np.int64))):
            np.add.at(own[:, column], up, values[hung])
        np.minimum.at(own[:, LOW], up, self.low[hung])
        rows, told = [], np.zeros(len(spine), bool)
        for path, nodes in self.spines:
            mine = np.where(told[nodes][:, None], np.array([0, NONE, 0, 0, 0, 0]), own[nodes])
            ends = [(d, self.ends[v]) for d, v in enumerate(nodes.tolist()) if v in self.ends and not told[v]]
            if not told[nodes].all():
                rows.append((path.seq.decode(), path.words.tolist(), np.ascontiguousarray(mine).tobytes(), [d for d, _ in ends], [x for _, x in ends]))
            told[nodes] = True
        return _batch(dict(zip(("seq", "words", "own", "depths", "shas"), map(list, zip(*rows, strict=True)), strict=True)))


def _range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of each range, by a sparse table of which one level is held at a time."""
    out, level = np.empty(len(first), np.int64), np.log2(last - first).astype(np.int64)
    for j in range(int(level.max()) + 1):
        here = np.flatnonzero(level == j)
        out[here] = np.minimum(values[first[here]], values[last[here] - (1 << j)])
        values = np.minimum(values[: -(1 << j)], values[1 << j :])
    return out


NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
ROWS = NODES + ", parent_key string, key string, seq string, words array<int>, own binary, depths array<int>, shas array<string>"
_TYPES = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in ROWS.split(", ")])


def _batch(columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns and not isinstance(columns[f.name], pa.Array) else columns.get(f.name, pa.nulls(n, f.type)) for f in _ARROW]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _shards(paths: DataFrame, whole: bool, named: bool, shard_nodes: int) -> DataFrame:
    """Node and spine rows of the shards of sorted ``paths``, a partition at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(Path.of(row))
                nodes += held[-1].size
                # Three paths at least, so that there are fewer spines than paths.
                if not whole and nodes >= shard_nodes and len(held) > 2:
                    yield from Shard(held, named).rows(whole)
                    held, nodes = [], 0
        if held:
            yield from Shard(held, named).rows(whole)

    return paths.mapInArrow(run, ROWS)


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): digest and word count of each conversation's turns, in order.

    Turns are ordered by ``turn``, null first, and then by digest; a null role
    or text is empty.  Rows without conv_id are no conversation.  The digests
    of one conversation, some 50 bytes a turn, make one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("n_words"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "n_words"))).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["n_words"].alias("n_words"))).alias("turns"))


def graft(lists: DataFrame, period: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of c - c % period.

    h is crc32 of the decimal id modulo ``most``; the other conversation gives
    all its turns if it has fewer, none if there is no such one.
    """
    base, h = F.col("conv_id") - F.col("conv_id") % period, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = lists.where(F.col("conv_id") % period == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    head = F.when(F.col("head").isNull(), F.slice("turns", F.lit(1), F.lit(0))).otherwise(F.slice("head", F.lit(1), h))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return lists.withColumn("base", base).join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _members(sequences: DataFrame, block_ids: int) -> DataFrame:
    """(key, n, low, sha): members of each sequence, the smallest one, and the digest of their list.

    Sorted ranges of (key, id) are written as blocks of text first, so that the
    one digest over a sequence's members streams over few rows.
    """

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(key, int(ids.iloc[i]), len(part), ",".join(map(str, part))) for key, ids in pdf.groupby("key", sort=False)["conv_id"] for i in range(0, len(ids), block_ids) for part in [ids.iloc[i : i + block_ids].tolist()]]
            yield pd.DataFrame(out, columns=["key", "first", "n", "ids"])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, low, sha = None, 0, 0, hashlib.sha256()
        for pdf in batches:
            out = []
            for k, first, count, ids in pdf.itertuples(index=False):
                if k == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        out.append((key, n, low, sha.hexdigest()))
                    key, n, low, sha = k, 0, first, hashlib.sha256()
                n += count
                sha.update(ids.encode())
            yield pd.DataFrame(out, columns=["key", "n", "low", "sha"])
        if key is not None:
            yield pd.DataFrame([(key, n, low, sha.hexdigest())], columns=["key", "n", "low", "sha"])

    ids = sequences.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    texts = ids.mapInPandas(blocks, "key string, first bigint, n bigint, ids string")
    return texts.repartition("key").sortWithinPartitions("key", "first").mapInPandas(digests, "key string, n bigint, low bigint, sha string")


def prefix_trie(lists: DataFrame, shard_nodes: int = SHARD_NODES, last_paths: int = LAST_PATHS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The nodes of the trie of ``lists(conv_id, turns)``, as :func:`turn_lists` gives them.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256): each distinct sequence of first turns, the empty one included;
    conv_id is the smallest member.  Conversations without turns end at the
    root, equal ones at one node.  Without conversations there are no nodes.
    Turns are equal if their digests are.
    """
    seq = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    sequences = lists.select("conv_id", F.md5(seq.cast("binary")).alias("key"), seq.alias("seq"), F.transform("turns", lambda t: t["n_words"]).alias("words"))
    sequences = materialise(sequences, "trie-sequences")
    none = {"own": "binary", "depths": "array<int>", "shas": "array<string>"}
    paths = _members(sequences, block_ids).join(sequences.select(F.col("conv_id").alias("low"), "seq", "words"), "low").withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    paths = paths.repartitionByRange("seq").sortWithinPartitions("seq")
    # A partition has many paths and a shard three at least, so each trie has fewer paths than the one before.
    last_paths = max(last_paths, 30)
    done, named, whole = [], False, False
    while True:
        rows = materialise(_shards(paths, whole, named, shard_nodes), "trie-nodes")
        done.append(rows)
        if whole:
            break
        spines = rows.where("seq IS NOT NULL").select("seq", "words", *none)
        count = spines.count()
        if not count:
            break
        named, whole = True, count <= last_paths
        paths = spines.repartitionByRange(1 if whole else -(-count // last_paths), "seq").sortWithinPartitions("seq")
    release(sequences)
    nodes = done[0].where("seq IS NULL")
    for rows in done[1:]:
        nodes = nodes.unionByName(rows.where("seq IS NULL"))
    names = [c.split()[0] for c in NODES.split(", ")]
    # Parents on a spine have their smallest member only now.
    spine = nodes.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    waiting = nodes.where("parent_key IS NOT NULL").drop("parent_conv_id").join(spine, "parent_key").withColumnRenamed("found", "parent_conv_id")
    out = materialise(nodes.where("parent_key IS NULL").select(names).unionByName(waiting.select(names)), "trie")
    for rows in done:
        release(rows)
    return out
