"""Exact top-k of lexical scores by range-maximum tables over document intervals.

Documents are cut into shards and numbered by id in each.  A posting list holds
a term's documents with their impact, the term's share of a document's score.
A sparse table over the lists gives the largest impact in any stretch of one, so
the sum of these maxima over an item's terms bounds the score of every document
of an interval.  Intervals are taken best first: the document with the largest
impact is scored, and the interval is split there.  The search of a shard ends
when no bound reaches the worst of the k best documents, which a task carries on
from shard to shard.  A short interval is scored as a whole.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyrisk.llm import hashing as H
from polyrisk.llm.common import materialise, release, text_slices

#: A shard is closed at so many documents or postings.
SHARD_DOCS = 8192
SHARD_POSTINGS = 1_000_000
#: Postings of an interval that is scored as a whole.
SHORT = 1024
#: Term hashes (bytes) of the items that are searched for together.
BLOCK_BYTES = 16 << 20
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
DOC_BITS = np.int64((1 << 32) - 1)
INDEX = "ids binary, named int, lengths binary, terms binary, docs binary, counts binary, n_docs bigint, n_terms bigint"


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of each text (A-Z as a-z) and each row's first term.

    A term is a run of ASCII letters and digits and of characters beyond ASCII.
    """
    buf, offsets = H.string_buffer(column)
    buf = np.where(TERM[buf], buf, np.uint8(32))
    starts, ends = H.word_spans(buf, offsets)
    return H.window_hashes(H.prefix_sums(buf, H.LOWER_TABLE), starts, ends), np.searchsorted(starts, offsets)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices([batch]):
            hashes, bounds = terms(part.column("text"))
            found = [np.unique(hashes[i:j]).tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("item"), part.column("item_id"), pa.array(found, pa.binary())], names=["item", "item_id", "terms"])


def build_index(docs: DataFrame, vocabulary: np.ndarray, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Postings of ``docs(doc_id, text)`` for the sorted term hashes, a row for each shard.

    Lengths and counts of documents are those of all terms.  Two terms are told
    apart by 64 hash bits.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def shard(parts: list[tuple]) -> pa.RecordBatch:
        ids, null, lengths = (np.concatenate([p[i] for p in parts]) for i in range(3))
        # Numbered by id, rows without one at the end.
        order = np.lexsort((ids, null))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        first = np.cumsum([0] + [len(p[0]) for p in parts])
        keys = np.concatenate([p[3] << np.int64(32) | rank[p[4] + f] for p, f in zip(parts, first, strict=False)])
        counts = np.concatenate([p[5] for p in parts])[by := np.argsort(keys, kind="stable")]
        keys = keys[by]
        row = [ids[order].tobytes(), int((~null).sum()), lengths[order].tobytes(), (keys >> np.int64(32)).astype(np.int32).tobytes(), (keys & DOC_BITS).astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), int((lengths > 0).sum()), int(lengths.sum())]
        kinds = [pa.binary(), pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts, size, postings = shared.value, [], 0, 0
        for part in text_slices(batches):
            for at in range(0, part.num_rows, shard_docs):
                piece = part.slice(at, shard_docs)
                hashes, bounds = terms(piece.column("text"))
                place = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                hit = np.flatnonzero(known[place] == hashes) if len(known) else np.zeros(0, np.int64)
                doc = np.searchsorted(bounds, hit, side="right") - 1
                keys, counts = np.unique(place[hit].astype(np.int64) << np.int64(32) | doc, return_counts=True)
                ids = piece.column("doc_id")
                parts.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), np.diff(bounds), keys >> np.int64(32), keys & DOC_BITS, counts))
                size, postings = size + piece.num_rows, postings + len(keys)
                if size >= shard_docs or postings >= SHARD_POSTINGS:
                    yield shard(parts)
                    parts, size, postings = [], 0, 0
        if parts:
            yield shard(parts)

    return docs.mapInArrow(run, INDEX)


def document_frequencies(index: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for held in batch.column("terms"):
                total += np.bincount(np.frombuffer(held.as_buffer(), np.int32), minlength=size) if len(held.as_buffer()) else 0
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), pa.array(total[here], pa.int64())], names=["term", "df"])

    out = np.zeros(size, np.int64)
    found = index.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out[found["term"]] = found["df"]
    return out


class Postings:
    """A shard's posting lists with impacts, and the sparse table of their maxima."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        term, doc, tf = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("terms", "docs", "counts"))
        named = doc < row["named"]
        term, doc, tf = term[named], doc[named], tf[named]
        lengths = np.frombuffer(row["lengths"], np.int64)
        if int(lengths.max(initial=0)) * n_docs * 90 >= 1 << 63:
            lengths = lengths.astype(object)
        m = (10 + 90 * lengths * n_docs // max(n_terms, 1)).astype(np.int64)
        self.keys = term << np.int64(32) | doc
        self.impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        longest = int(np.bincount(term).max(initial=0))
        # Place of the largest impact among 2**level postings from each on.
        self.table = [np.arange(len(term), dtype=np.int32)]
        while 2 << len(self.table) - 1 <= longest:
            last, step = self.table[-1], 1 << len(self.table) - 1
            right = np.concatenate([last[step:], last[-step:]])
            self.table.append(np.where(self.impact[last] >= self.impact[right], last, right))
        self.table = np.stack(self.table)

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of the largest impact in each range of postings."""
        level = np.frexp(hi - lo)[1] - 1
        left, right = self.table[level, lo], self.table[level, hi - (1 << level)]
        return np.where(self.impact[left] >= self.impact[right], left, right)

    def search(self, wanted: np.ndarray, best: list, k: int) -> None:
        """Bring ``best``, a heap of (score, -id), up to date with this shard."""
        if not len(self.keys):
            return
        turn, heap = count(), []

        def offer(score: int, doc: int) -> None:
            entry = (score, -int(self.ids[doc]))
            if score > 0 and len(best) < k:
                heapq.heappush(best, entry)
            elif score > 0 and entry > best[0]:
                heapq.heapreplace(best, entry)

        def reaches(bound: int, first: int) -> bool:
            """Whether a document from ``first`` on, of at most this score, can still be among the best."""
            return bound > 0 and (len(best) < k or (bound, -int(self.ids[first])) > best[0])

        def push(first: int, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            some = np.flatnonzero(lo < hi)
            if len(some):
                term, lo, hi = term[some], lo[some], hi[some]
                top = self.maxima(lo, hi)
                bound = int(self.impact[top].sum())
                if reaches(bound, first):
                    heapq.heappush(heap, (-bound, next(turn), first, term, lo, hi, top))

        push(0, wanted, np.searchsorted(self.keys, wanted << np.int64(32)), np.searchsorted(self.keys, (wanted + 1) << np.int64(32)))
        while heap:
            bound, _, first, term, lo, hi, top = heapq.heappop(heap)
            if not reaches(-bound, first):
                continue
            size = hi - lo
            if (total := int(size.sum())) <= SHORT:
                at = np.arange(total) + np.repeat(lo - np.cumsum(size) + size, size)
                docs = self.keys[at] & DOC_BITS
                order = np.argsort(docs, kind="stable")
                starts = np.flatnonzero(np.diff(docs[order], prepend=-1))
                scores, docs = np.add.reduceat(self.impact[at[order]], starts), docs[order][starts]
                for i in np.lexsort((docs, -scores))[:k].tolist():
                    offer(int(scores[i]), int(docs[i]))
                continue
            split = int(self.keys[top[self.impact[top].argmax()]] & DOC_BITS)
            keys = term << np.int64(32) | split
            mid = np.searchsorted(self.keys, keys)
            met = self.keys[np.minimum(mid, len(self.keys) - 1)] == keys
            offer(int(self.impact[mid[met]].sum()), split)
            push(first, term, lo, mid)
            if split + 1 < len(self.ids):
                push(split + 1, term, mid + met, hi)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, shard_docs: int = SHARD_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents for every row of ``items(item_id, text)``.

    With N documents that hold a term, L terms in all, n in the document and df
    documents that hold the term: weight w = floor(1000 ln((2N + 2) / (2 df + 1))),
    m = 10 + 90 n N div L, score = sum of w (10**9 tf div (1000 tf + 8 m)) over an
    item's terms, once each.  Only scores above 0; equal scores by ascending id.

    Null texts have no terms.  Every row is a document or item of its own:
    repeated rows are ranked and answered each.  Documents without an id count
    but are not ranked; items without an id are answered under null.  An item or
    a table without terms has no result.  Other columns are ignored.
    """
    listed = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), F.col("text").cast("string").alias("text"))
    listed = materialise(listed.mapInArrow(_item_terms, f"item bigint, item_id {items.schema['item_id'].dataType.simpleString()}, terms binary"), "ranked-items")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The items' terms are broadcast; blocks of items keep them to a fixed size, each block a pass over the documents.
    blocks = max(1, -(-int(listed.agg(F.sum(F.octet_length("terms"))).first()[0] or 0) // block_bytes))
    found, files = None, []
    for b in range(blocks):
        part = listed.where(F.pmod(F.hash("item"), F.lit(blocks)) == b).select("item", "terms").toPandas()
        wanted = {int(i): np.frombuffer(t, np.uint64) for i, t in zip(part["item"], part["terms"], strict=True) if t}
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *wanted.values()]))
        wanted = {i: np.searchsorted(vocabulary, t).astype(np.int64) for i, t in wanted.items()}
        files.append(materialise(build_index(texts, vocabulary, shard_docs), "ranked-index"))
        top = _search(files[-1], wanted, len(vocabulary), k)
        found = top if found is None else found.unionByName(top)
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = materialise(ranked.join(listed.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    for df in (listed, *files):
        release(df)
    return out


def _search(index: DataFrame, wanted: dict[int, np.ndarray], size: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of every item."""
    totals = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = (int(x or 0) for x in totals)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in document_frequencies(index, size)], np.int64)
    shared = index.sparkSession.sparkContext.broadcast((wanted, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = shared.value
        best: dict[int, list] = {item: [] for item in wanted}
        for batch in batches:
            for i in range(batch.num_rows):
                lists = Postings({c: batch.column(c)[i].as_py() for c in batch.schema.names}, weights, n_docs, n_terms)
                for item, term in wanted.items():
                    lists.search(term, best[item], k)
        rows = [(item, -low, score) for item, heap in best.items() for score, low in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item bigint, doc_id bigint, score bigint")
