"""Repeated byte strings across a corpus by difference-cover suffix sampling.

A difference cover D modulo v has, for any two positions i and j, a shift
below v that moves both into sampled positions (residue in D).  So two equal
strings of ``length`` bytes contain equal sampled tuples of length - v + 1
bytes at equal places.  The corpus is worked on in these steps, each one sort
of keys that are dealt out by their leading bits:

1. sort the sampled tuples; a tuple gets a name shared by its equals, and
   tuples with a unique name are dropped, as no repeat can hold them;
2. recurse on the names that are left with longer prefixes (and a prefix that
   begins before the position), again dropping unique ones; a prefix of
   length + 2 v bytes that repeats settles a whole run of positions;
3. merge the remaining suffixes: every position within v before a sampled
   suffix that is still open is sorted by its first ``length`` bytes;
4. compare neighbours in that order: equal prefixes are repeats.

Tuples are sorted by 64-bit hashes of their bytes, in place of the bytes; what
is equal still stands together.  Only keys travel, as packed arrays, and one
bit for each comes back.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrisk.llm import hashing as H
from polyrisk.llm.common import materialise, scratch_path, shuffle_partitions, text_slices

CHUNK_BYTES = 1 << 20
KEY_ROWS = "bucket int, kind int, chunk bigint, n int, keys binary, flags binary"
MARK_ROWS = "chunk bigint, kind int, bucket int, n int, bits binary"
TUPLE, RIGHT, LEFT, LONG, OPEN, WHOLE = range(6)
#: Bytes of a key that travel besides its bucket.
KEY_BYTES = 7


def difference_cover(length: int) -> tuple[int, np.ndarray]:
    """(v, D) of the largest known perfect cover that leaves tuples of three tenths of ``length``."""
    closed = lambda v, *seeds: np.unique([s * 2**k % v for s in seeds for k in range(20)])
    covers = [(1, np.array([0])), (3, np.array([0, 1])), (7, closed(7, 1)), (13, np.array([0, 1, 3, 9])), (73, closed(73, 1)), (273, closed(273, 1, 91, 117))]
    return [c for c in covers if c[0] <= max(1, 0.7 * (length + 2))][-1]


class Chunk:
    """Some whole documents; positions count from the chunk's start."""

    def __init__(self, data: bytes | pa.Buffer, sizes: np.ndarray, length: int, buckets: dict[int, int], marks: list | None):
        self.length, self.buckets = length, buckets
        self.v, self.cover = difference_cover(length)
        self.half, self.tuple = self.v // 2, length - self.v + 1
        self.buf = np.frombuffer(data, np.uint8) if len(data) else np.zeros(0, np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.sums = H.prefix_sums(self.buf)
        self.found: dict[int, dict[int, np.ndarray]] = {}
        for m in marks or []:
            self.found.setdefault(m["kind"], {})[m["bucket"]] = np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=m["n"]).astype(bool)
        long_docs = np.flatnonzero(np.asarray(sizes) >= length)
        longest = int(max((sizes[i] for i in long_docs), default=0))
        grid = (np.arange(longest // self.v + 1)[:, None] * self.v + self.cover[None, :]).ravel()
        grid.sort()
        parts = [self.bounds[i] + grid[: np.searchsorted(grid, sizes[i] - self.tuple, side="right")] for i in long_docs]
        self.at = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        self.owner = np.repeat(long_docs, [len(p) for p in parts])
        #: Positions where a string of ``length`` bytes may start.
        self.valid = np.zeros(len(self.buf) + 1, bool)
        for i in long_docs:
            self.valid[self.bounds[i] : self.bounds[i + 1] - length + 1] = True

    def hashes(self, starts: np.ndarray, size: int) -> np.ndarray:
        return H.window_hashes(self.sums, starts, starts + size)

    def send(self, kind: int, hashes: np.ndarray, flags: np.ndarray | None = None) -> Iterator[tuple]:
        """Key rows: the distinct hashes in order, cut by bucket, with a flag each.

        Without ``flags`` a key is flagged if it occurs twice here; with them,
        if one of its positions is flagged.
        """
        keys, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        flagged = counts > 1 if flags is None else np.bincount(inverse, flags, minlength=len(keys)) > 0
        for b, i, j in self._cuts(kind, keys):
            packed = keys[i:j].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()
            yield b, kind, j - i, packed, np.packbits(flagged[i:j]).tobytes()

    def _cuts(self, kind: int, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        # A bucket holds a range of the leading 32 bits, so its keys stand together.
        n = self.buckets[kind]
        edges = np.array([-(-(i << 32) // n) for i in range(n + 1)], np.uint64)
        cuts = np.searchsorted(keys >> np.uint64(32), edges)
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
            yield int(b), int(cuts[b]), int(cuts[b + 1])

    def answer(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        """The bit that came back for each hash that :meth:`send` sent."""
        keys, inverse = np.unique(hashes, return_inverse=True)
        bits, got = np.zeros(len(keys), bool), self.found.get(kind, {})
        for b, i, j in self._cuts(kind, keys):
            if b in got:
                bits[i:j] = got[b]
        return bits[inverse]

    def tuples(self) -> np.ndarray:
        return self.hashes(self.at, self.tuple)

    def shared(self) -> None:
        """Keep the sampled positions whose tuple has a name that is not unique."""
        names = self.tuples()
        keep = self.answer(TUPLE, names)
        self.at, self.owner, self.names = self.at[keep], self.owner[keep], names[keep]

    def longer(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each further kind: (which sampled positions have it, hashes of those)."""
        lo, hi = self.bounds[self.owner], self.bounds[self.owner + 1]
        out = {}
        for kind, back, ahead in ((RIGHT, 0, self.length - self.half), (LEFT, self.half, self.tuple), (LONG, 0, self.length + 2 * self.v)):
            has = np.flatnonzero((self.at - back >= lo) & (self.at + ahead <= hi))
            out[kind] = (has, self.hashes(self.at[has] - back, back + ahead))
        return out

    def settle(self) -> None:
        """After step 2: settled positions, and the positions that each sampled suffix leaves open."""
        repeats = {}
        for kind, (has, hashes) in self.longer().items():
            repeats[kind] = np.zeros(len(self.at), bool)
            repeats[kind][has] = self.answer(kind, hashes)
        self.settled = _spread(len(self.buf) + 1, self.at[repeats[LONG]], self.at[repeats[LONG]] + 2 * self.v + 1)
        lo = self.bounds[self.owner]
        self.first = np.maximum(np.where(repeats[LEFT], self.at - self.v + 1, self.at - self.half), lo)
        self.last = np.where(repeats[RIGHT], self.at + 1, self.at - self.half)
        self.last = np.maximum(self.last, self.first)
        open_here = np.concatenate([[0], np.cumsum(self.valid & ~self.settled)])
        self.open = open_here[np.minimum(self.last, len(self.valid))] > open_here[self.first]

    def starts(self) -> np.ndarray:
        """Step 3: the positions to be merged, those whose name is open in any document."""
        wanted = self.answer(OPEN, self.names)
        spread = _spread(len(self.valid), self.first[wanted], self.last[wanted])
        return np.flatnonzero(spread & self.valid)

    def repeated(self) -> np.ndarray:
        """Step 4: which bytes are covered by a repeated string."""
        starts = self.starts()
        same = self.settled & self.valid
        same[starts] |= self.answer(WHOLE, self.hashes(starts, self.length))
        at = np.flatnonzero(same)
        return _spread(len(self.buf), at, at + self.length)


def _spread(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the union of ranges."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, np.clip(starts, 0, size), 1)
    np.add.at(steps, np.clip(ends, 0, size), -1)
    return np.cumsum(steps)[:size] > 0


def _chunks(docs: DataFrame) -> DataFrame:
    """(chunk, ids, sizes, data): whole documents as UTF-8 bytes, about a megabyte a row.

    Kept as a table that is bucketed by chunk, so that later steps bring their
    marks to the texts and never move the texts again.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for part in text_slices(batches, limit=CHUNK_BYTES):
            buf, offsets = H.string_buffer(part.column("text"))
            sizes = pa.array([np.diff(offsets)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), sizes, pa.array([buf.tobytes()], pa.binary())], names=["chunk", "ids", "sizes", "data"])
            chunk += 1

    rows = docs.mapInArrow(run, "chunk bigint, ids array<bigint>, sizes array<bigint>, data binary")
    buckets, name = shuffle_partitions(spark), f"suffix_chunks_{uuid.uuid4().hex}"
    rows.repartition(buckets, "chunk").write.option("compression", "zstd").bucketBy(buckets, "chunk").option("path", scratch_path(spark, "suffix-chunks")).saveAsTable(name)
    return spark.table(name)


def _compare(keys: DataFrame, flagged_only: bool) -> DataFrame:
    """Sort each bucket's keys; mark those that meet an equal one (or a flagged one) elsewhere."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = pdf["n"].to_numpy()
        packed = np.frombuffer(b"".join(pdf["keys"]), np.uint8).reshape(-1, KEY_BYTES)
        values = np.zeros((len(packed), 8), np.uint8)
        values[:, :KEY_BYTES] = packed
        values = values.view("<u8").ravel()
        flags = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(pdf["flags"], counts, strict=True)]).astype(bool)
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        group = np.cumsum(head) - 1
        hit = np.bincount(group, flags[order]) > 0
        if not flagged_only:
            hit |= np.bincount(group) > 1
        bits = np.zeros(len(values), bool)
        bits[order] = hit[group]
        ends = np.cumsum(counts)
        out = pdf[["chunk", "kind", "bucket", "n"]].copy()
        out["bits"] = [np.packbits(bits[e - n : e]).tobytes() for e, n in zip(ends, counts, strict=True)]
        return out[[bool(bits[e - n : e].any()) for e, n in zip(ends, counts, strict=True)]]

    return keys.groupBy("bucket", "kind").applyInPandas(run, MARK_ROWS)


def _step(chunks: DataFrame, marks: DataFrame | None, schema: str, work: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """Run ``work`` on every chunk row with the marks that have come back for it."""
    if marks is None:
        rows = chunks.withColumn("marks", F.lit(None).cast("array<struct<kind:int,bucket:int,n:int,bits:binary>>"))
    else:
        grouped = marks.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "n", "bits")).alias("marks"))
        rows = chunks.join(grouped.hint("shuffle_merge"), "chunk", "left")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {
                    "chunk": batch.column("chunk")[i].as_py(),
                    "ids": batch.column("ids")[i].as_py(),
                    "sizes": pc.list_flatten(batch.column("sizes").slice(i, 1)).to_numpy(),
                    "data": batch.column("data")[i].as_buffer(),
                    "marks": batch.column("marks")[i].as_py(),
                }
                out = list(work(row))
                if out:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names), schema=kinds, preserve_index=False)

    kinds = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)])
    return rows.select("chunk", "ids", "sizes", "data", "marks").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of ``docs``.

    Removes each byte covered by a string of ``length`` UTF-8 bytes that also
    starts anywhere else in the corpus, the same document included; overlaps
    count, matches never cross documents, and strings are judged on the input.
    Null texts are empty; texts shorter than ``length`` lose nothing.  Rows are
    documents: repeated rows are copies of each other, ids may repeat or be
    null.  An empty table gives an empty result, other columns are ignored.
    Strings are compared by 56 bits of a hash within buckets of bounded load
    (about one string in 10**10 could meet a false equal).
    """
    if length < 2:
        raise ValueError("length is 2 or more")
    chunks = _chunks(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    total = chunks.agg(F.sum(F.length("data"))).first()[0] or 0
    v, cover = difference_cover(length)
    load = lambda keys: max(1, -(-int(keys) // 1_000_000))
    few = load(total * len(cover) / v)
    buckets = {TUPLE: few, RIGHT: few, LEFT: few, LONG: few, OPEN: few, WHOLE: load(total / 4)}
    make = lambda row: Chunk(row["data"], row["sizes"], length, buckets, row["marks"])

    def tuples(row: dict) -> Iterator[tuple]:
        chunk = make(row)
        for b, kind, n, keys, flags in chunk.send(TUPLE, chunk.tuples()):
            yield b, kind, row["chunk"], n, keys, flags

    def prefixes(row: dict) -> Iterator[tuple]:
        if row["marks"]:
            chunk = make(row)
            chunk.shared()
            for kind, (_, hashes) in chunk.longer().items():
                for b, _, n, keys, flags in chunk.send(kind, hashes):
                    yield b, kind, row["chunk"], n, keys, flags

    def opened(row: dict) -> Iterator[tuple]:
        if row["marks"]:
            chunk = make(row)
            chunk.shared()
            chunk.settle()
            for b, kind, n, keys, flags in chunk.send(OPEN, chunk.names, chunk.open):
                yield b, kind, row["chunk"], n, keys, flags

    def merged(row: dict) -> Iterator[tuple]:
        if row["marks"]:
            chunk = make(row)
            chunk.shared()
            chunk.settle()
            for b, kind, n, keys, flags in chunk.send(WHOLE, chunk.hashes(chunk.starts(), length)):
                yield b, kind, row["chunk"], n, keys, flags

    def result(row: dict) -> Iterator[tuple]:
        sizes, data = row["sizes"], np.frombuffer(row["data"], np.uint8) if len(row["data"]) else np.zeros(0, np.uint8)
        gone = np.zeros(len(data), bool)
        if row["marks"]:
            chunk = make(row)
            chunk.shared()
            chunk.settle()
            gone = chunk.repeated()
        ends = np.cumsum(sizes)
        for doc_id, size, end in zip(row["ids"], sizes, ends, strict=True):
            mask, text = gone[end - size : end], data[end - size : end]
            spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
            left = text[~mask].tobytes()
            out = (doc_id, int(size), int(mask.sum()), spans, hashlib.sha256(left).hexdigest())
            yield (*out, left) if keep_bytes else out

    marks = None
    for work, flagged_only in ((tuples, False), (prefixes, False), (opened, True), (merged, False)):
        got = materialise(_compare(_step(chunks, marks, KEY_ROWS, work), flagged_only), "suffix-marks")
        marks = got if marks is None else marks.unionByName(got)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_bytes
    return _step(chunks, marks, schema, result)
