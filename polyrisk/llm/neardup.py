"""Near-duplicate documents by one-permutation MinHash with optimal densification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrisk.llm import hashing as H
from polyrisk.llm.common import materialise, release, text_slices
from polyrisk.llm.components import connected_components


#: Bytes of text whose shingles a Python worker holds at once.
TEXT_BYTES = 1 << 18


class Signer:
    """Band keys of a shingle set: one permutation cut into bins, empty bins filled from others."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        edges = [-(-(i << 64) // self.bins) for i in range(1, self.bins)]
        self.edges = np.array(edges, np.uint64)
        # Each empty bin asks other bins in an order of its own (the same for all sets).
        self.donors = np.random.default_rng(11).integers(0, self.bins, (self.bins, 4096), dtype=np.int32)
        self.salt = H.finalise(np.arange(1, bands + 1, dtype=np.uint64))

    def keys(self, shingle_set: np.ndarray) -> np.ndarray:
        """``shingle_set`` is sorted and not empty; a bin's value is its smallest element."""
        starts = np.concatenate([[0], np.searchsorted(shingle_set, self.edges), [len(shingle_set)]])
        filled = starts[1:] > starts[:-1]
        source = np.arange(self.bins)
        empty = np.flatnonzero(~filled)
        for first, last in ((0, 16), (16, 256), (256, 4096)):
            if len(empty):
                hit = filled[self.donors[empty, first:last]]
                found = hit.any(axis=1)
                source[empty[found]] = self.donors[empty[found], first + hit[found].argmax(axis=1)]
                empty = empty[~found]
        source[empty] = np.flatnonzero(filled)[0]
        sig = shingle_set[starts[source]].reshape(self.bands, self.rows)
        return H.finalise((sig * H.PLACES[: self.rows]).sum(axis=1, dtype=np.uint64) + self.salt)


def set_key(shingle_set: np.ndarray) -> bytes:
    """128 bits that name a set."""
    a = (H.finalise(shingle_set) * H.PLACES[0]).sum(dtype=np.uint64)
    b = H.finalise(shingle_set ^ H.PLACES[1]).sum(dtype=np.uint64)
    return np.array([a, b], ">u8").tobytes()


def _sets(part: pa.RecordBatch, width: int) -> list[np.ndarray]:
    found, bounds = H.shingles(*H.words(part.column("text")), width)
    return [np.unique(found[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def sign(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, cls, keys): ``cls`` names the shingle set, null when it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for part in text_slices(batches, limit=TEXT_BYTES):
            sets = _sets(part, width)
            keys = [signer.keys(s).astype(np.int64) if len(s) else None for s in sets]
            names = [set_key(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "cls", "keys"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, cls binary, keys array<bigint>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(cls, n, items): the sorted 64-bit shingles of each text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=TEXT_BYTES):
            sets = [s for s in _sets(part, width) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "items"])

    return docs.mapInArrow(run, "cls binary, items binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                if 100 * len(small) >= percent * len(large):
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    both = int((large[at] == small).sum())
                    keep[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


#: Slots of the shingle counts that order a set from rare to common; collisions change the order, not the result.
SLOT_BITS = 16
#: Buckets of at most so many classes are finished by comparing all their pairs.
SMALL = 32
#: Rounds of new centres go on while more than one in so many compared pairs is a link.
PRODUCTIVE = 20


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each slot (a fixed number of slots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for items in batch.column("items"):
                held += np.bincount(np.frombuffer(items.as_buffer(), np.uint64) >> np.uint64(64 - SLOT_BITS), minlength=len(held))
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(held[found])], names=["slot", "n"])

    out = np.zeros(1 << SLOT_BITS, np.int64)
    for r in sets.select("items").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def _size_blocks(last: int) -> np.ndarray:
    """First sizes of the blocks, each a tenth longer than the one before, up to ``last``."""
    edges = [1]
    while edges[-1] <= last:
        edges.append(max(edges[-1] + 1, edges[-1] * 11 // 10))
    return np.array(edges, np.int64)


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) among ``sets(cls, items, root, minor)``: every pair that can reach ``percent`` is there.

    A pair of m and n >= m shingles over the threshold has at least
    o = ceil(t(m + n) / (1 + t)) in common.  With shingles in one order for all
    sets, rare ones first, it shares one of the first m - o + 1 of the smaller
    and n - o + 1 of the larger set.  The larger set gives a prefix of its own
    for each block of sizes its partner may have, so a shingle that many sets
    hold late in their order meets none of the sets that hold it early but
    are too long for it; within a block the exact sizes and places decide.
    Pairs with the same root, and those where neither is ``minor``, are left
    out.
    """
    counts = _slot_counts(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, items in enumerate(batch.column("items")):
                found = np.frombuffer(items.as_buffer(), np.uint64)
                n = len(found)
                edges = _size_blocks(n)
                ranked = found[np.lexsort((found, counts[found >> np.uint64(64 - SLOT_BITS)]))].view(np.int64)
                least = -(-percent * n // 100)
                own = int(np.searchsorted(edges, n, "right")) - 1
                # (block, length of the prefix, whether this set is the smaller one)
                cuts = [(own, n + (-2 * percent * n // (100 + percent)) + 1, True)]
                for block in range(int(np.searchsorted(edges, least, "right")) - 1, own + 1):
                    cuts.append((block, n + (-percent * (n + max(least, int(edges[block]))) // (100 + percent)) + 1, False))
                sizes = [length for _, length, _ in cuts]
                same = pa.array(np.full(sum(sizes), i))
                columns = [
                    pa.array(np.concatenate([ranked[:k] for k in sizes])),
                    pa.array(np.repeat([block for block, _, _ in cuts], sizes).astype(np.int32)),
                    pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])),
                    *(batch.column(c).take(same) for c in ("cls", "root", "minor")),
                    pa.array(np.full(sum(sizes), n)),
                    pa.array(np.repeat([smaller for _, _, smaller in cuts], sizes)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "block", "place", "cls", "root", "minor", "n", "smaller"])

    rare = sets.select("cls", "root", "minor", "items").mapInArrow(run, "item bigint, block int, place int, cls binary, root binary, minor boolean, n bigint, smaller boolean")
    rare = materialise(rare, "neardup-rare")
    p = rare.where("NOT smaller").select("item", "block", *(F.col(c).alias(f"p_{c}") for c in ("place", "cls", "root", "minor", "n")))
    fits = F.expr(
        f"root <> p_root AND struct(n, cls) < struct(p_n, p_cls) AND 100 * n >= {percent} * p_n"
        f" AND {100 + percent} * least(n - place, p_n - p_place) >= {percent} * (n + p_n)"
    )

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, ["item", "block"]).where(fits).select(F.col("cls").alias("a"), F.col("p_cls").alias("b"))

    lead = rare.where("smaller")
    pairs = meet(lead.where("minor"), p).union(meet(lead.where("NOT minor"), p.where("p_minor"))).distinct()
    pairs = materialise(pairs, "neardup-pairs")
    release(rare)
    return pairs


def finish(buckets: DataFrame, roots: DataFrame, tried: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links between components that the star-shaped candidates left out.

    Buckets of at most ``SMALL`` classes compare all pairs of several
    components; the classes of larger ones are joined on their rare shingles.
    Both are complete, so no pair of a bucket is left undecided.
    """
    placed = buckets.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    by_root = placed.groupBy("key", "root").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    # A pair of two components has at least one class outside the bucket's largest one.
    mixed = by_root.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("major"), F.count("*").alias("parts")).where("parts > 1").select("key", "major")
    placed = materialise(placed.where("n > 2").join(mixed, "key"), "neardup-mixed")
    x, y = (placed.where(f"n <= {SMALL}").select("key", F.col("cls").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
    pairs = x.join(y, "key").where("a_root <> b_root AND a < b").select("a", "b").distinct()
    large = placed.where(f"n > {SMALL}").groupBy("cls", "root").agg(F.max(F.col("root") != F.col("major")).alias("minor"))
    scratch = [placed]
    if large.limit(1).count():
        large = materialise(sets.join(large, "cls"), "neardup-large")
        rare = prefix_pairs(large, percent)
        scratch += [large, rare]
        pairs = pairs.union(rare.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialise(pairs.join(done, ["a", "b"], "left_anti"), "neardup-tried")
    links = materialise(verify(pairs, sets, percent), "neardup-links")
    for table in [*scratch, pairs]:
        release(table)
    return links


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    width: int = 5,
    bands: int = 24,
    rows: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Texts with equal shingle sets are one class.  Classes that share a band
    bucket are linked to the bucket's centre first (star-shaped candidates), so
    candidates grow with bucket size, not its square.  The first centre is the
    class that meets most others over all its buckets; every further round
    takes another centre in each bucket that still holds several components,
    as long as one in ``PRODUCTIVE`` of its pairs is a link, so the rounds
    are about as many as a bucket holds large groups.  What the buckets still
    hold in several components is then decided in whole by :func:`finish`.
    Candidates count as links only after comparing the full sets.

    Rows with an empty set (null or blank text) stay alone.  Repeated rows and
    ids fall together; rows without an id are in no group: their component is
    null and they are kept.  An empty table gives an empty result; other
    columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(sign(docs, width, bands, rows), "neardup-signed")
    classes = signed.where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    classes = materialise(classes, "neardup-classes")
    buckets = classes.select("cls", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialise(buckets.join(shared, "key"), "neardup-buckets")
    meets = buckets.groupBy("cls").agg(F.sum("n").alias("meets"))
    centres = buckets.join(meets, "cls").groupBy("key").agg(F.max_by("cls", F.struct("meets", "cls")).alias("b"))
    pairs = buckets.join(centres, "key").where("cls <> b").select(F.col("cls").alias("a"), "b").distinct()
    # Full sets are made again for the classes that meet another one.
    wanted = buckets.select("cls").distinct().join(classes.select("cls", "rep"), "cls").select(F.col("rep").alias("doc_id"))
    sets = full_sets(docs.join(wanted.distinct(), "doc_id", "left_semi"), width)
    sets = materialise(sets.groupBy("cls").agg(F.first("items").alias("items")), "neardup-sets")
    tried = materialise(pairs, "neardup-tried")
    links = materialise(verify(tried, sets, percent), "neardup-links")
    turn, productive = 0, True
    while True:
        roots = materialise(connected_components(links), "neardup-roots")
        if not productive:
            break
        turn += 1
        placed = buckets.select("key", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by(F.struct("cls", "root"), F.xxhash64("cls", F.lit(turn))).alias("c")).where("lo <> hi").select("key", "c")
        more = placed.join(mixed, "key").where("root <> c.root").select(F.col("cls").alias("a"), F.col("c.cls").alias("b")).distinct()
        more = materialise(more.join(tried, ["a", "b"], "left_anti"), "neardup-tried")
        fresh = materialise(verify(more, sets, percent), "neardup-links")
        n_more, n_fresh = more.count(), fresh.count()
        tried = tried.union(more)
        productive = n_fresh * PRODUCTIVE > n_more
        if not n_fresh:
            break
        links = links.union(fresh)
    fresh = finish(buckets, roots, tried, sets, percent)
    if fresh.limit(1).count():
        roots = materialise(connected_components(links.union(fresh)), "neardup-roots")
    for scratch in (buckets, sets, tried, links, fresh):
        release(scratch)
    first = roots.join(classes.select(F.col("cls").alias("node"), "rep"), "node").groupBy("root").agg(F.min("rep").alias("low"))
    lows = roots.join(first, "root").select(F.col("node").alias("cls"), "low")
    lows = classes.select("cls", "rep").join(lows, "cls", "left").select("cls", F.coalesce("low", "rep").alias("low"))
    # Only classes that are linked or have copies change a row's component.
    return (
        signed.select("doc_id", "n_shingles", "cls")
        .join(lows, "cls", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
