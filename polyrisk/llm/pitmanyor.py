"""Hierarchical Pitman-Yor language model, trained by Gibbs sweeps in Spark.

Restaurants: one for each word that comes before (and one for the start of a
text), all with the same parent, the unigram restaurant, whose base is uniform
over the vocabulary and one unknown word.  A sweep seats the customers of every
(context, word) again, one after another, given the other restaurants'
totals of the sweep before; tables of the contexts are the customers of the
parent.  Predictive probabilities are averaged over several seatings.

The text is read into chunks.  A chunk sends each of its distinct (word,
context) pairs with its training count to the bucket of the word's hash, and
gets one probability for each back; tokens themselves never travel.  A bucket
holds all contexts of its words; the contexts' totals are summed in parts by
the context's hash, and each bucket gets back those that it asked for.

A chunk keeps its tokens as ranks by frequency, and finds its pairs in them
again when it needs them.  All numbers are written as compressed byte planes,
sorted ones as steps, and scratch that no later sweep reads is deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyrisk.llm import hashing as H
from polyrisk.llm.common import materialise, release, scratch_path, shuffle_partitions, text_slices

#: Text bytes of a chunk, and of the slices that are hashed at once.
CHUNK_BYTES, SLICE = 6 << 20, 1 << 20
#: Words are known by the upper 48 bits of a hash.
WORD_BITS, WORD_BYTES = np.uint64(0xFFFFFFFFFFFF0000), 6
END, START = H.finalise(np.array([0xE0D, 0x57A27], np.uint64)) & WORD_BITS
#: (word, context) pairs of a bucket, counted once for each chunk.
BUCKET_PAIRS = 500_000
#: Parts of the contexts are fewer than buckets, which ask for far fewer contexts than they have pairs.
BUCKETS_PER_PART = 8
DOC_ROWS = "chunk bigint, ids array<bigint>, held array<boolean>, sizes array<bigint>, tokens binary, words binary, pairs bigint"
SENT_ROWS = "bucket int, chunk bigint, first bigint, n bigint, words binary, runs binary, contexts binary, counts binary"
PAIR_ROWS = "bucket int, chunk bigint, first bigint, n bigint, place binary, contexts binary, runs binary, context binary, counts binary"
ASK_ROWS = "part int, bucket int, contexts binary, customers binary, tables binary, sums array<double>"
PART_ROWS = "part int, bucket int, places binary, customers binary, tables binary, sums array<double>"
REPLY_ROWS = "bucket int, part int, tables binary"
STATE_ROWS = "bucket int, part int, tables binary, root_tables binary, sums array<double>"


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, contexts, tokens per row): each word and then one end, and the word before each or the start."""
    buf, offsets = H.string_buffer(column)
    starts, ends = H.word_spans(buf, offsets)
    hashes, bounds = H.window_hashes(H.prefix_sums(buf, H.LOWER_TABLE), starts, ends), np.searchsorted(starts, offsets)
    rows = len(offsets) - 1
    sizes = np.diff(bounds) + 1
    words = np.full(len(hashes) + rows, END, np.uint64)
    words[np.arange(len(hashes)) + np.repeat(np.arange(rows), np.diff(bounds))] = hashes & WORD_BITS
    contexts = np.concatenate([[START], words])[:-1]
    contexts[np.cumsum(sizes) - sizes] = START
    return words, contexts, sizes


def packed(words: np.ndarray) -> bytes:
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - WORD_BYTES :].tobytes()


def unpacked(parts: list[bytes]) -> np.ndarray:
    found = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WORD_BYTES)
    out = np.zeros((len(found), 8), np.uint8)
    out[:, 8 - WORD_BYTES :] = found
    return out.view("<u8").ravel()


def squeezed(values: np.ndarray, steps: bool = False) -> bytes:
    """Whole numbers below 2**48, or the steps between them, as compressed planes of their bytes."""
    values = np.diff(values.astype(np.int64), prepend=0) if steps else values
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].T.tobytes()
    return len(values).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def numbers(parts: Iterable[bytes], steps: bool = False) -> np.ndarray:
    """The numbers of all parts, which :func:`squeezed` wrote."""
    found = [np.zeros(0, np.int64)]
    for part in parts:
        size = int.from_bytes(part[:4], "little")
        planes = np.frombuffer(pa.decompress(part[4:], size * WORD_BYTES, "zstd", asbytes=True), np.uint8).reshape(WORD_BYTES, size)
        out = np.zeros((size, 8), np.uint8)
        out[:, :WORD_BYTES] = planes.T
        out = out.view("<i8").ravel()
        found.append(np.cumsum(out) & ((1 << 8 * WORD_BYTES) - 1) if steps else out)
    return np.concatenate(found)


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, lengths) of the runs of equal neighbours."""
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])
    return heads, np.diff(heads, append=len(values))


class Pairs:
    """A chunk's distinct pairs in the order of (word, context), each token's place among them, and training counts."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, held: np.ndarray):
        order = np.argsort(words)
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        self.words, at = words[order], number[tokens]
        before = np.concatenate([[0], at])[:-1]
        before[np.cumsum(sizes) - sizes] = np.searchsorted(self.words, START)
        pairs, self.place = np.unique(at * len(words) + before, return_inverse=True)
        self.word, self.context = np.divmod(pairs, len(words))
        self.counts = np.bincount(self.place[np.repeat(~held, sizes)], minlength=len(pairs))

    @classmethod
    def of_row(cls, batch: pa.RecordBatch, i: int) -> Pairs:
        sizes, held = (pc.list_flatten(batch.column(c).slice(i, 1)).to_numpy(zero_copy_only=False) for c in ("sizes", "held"))
        return cls(unpacked([batch.column("words")[i].as_py()]), numbers([batch.column("tokens")[i].as_py()]), sizes, held)


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole documents: each token's rank among the chunk's distinct words, by frequency, and these (and the start)."""
    chunk, held_bytes, parts = TaskContext.get().partitionId() << 33, 0, []

    def flush() -> pa.RecordBatch:
        sizes = np.concatenate([p[2] for p in parts])
        held = [h for p in parts for h in p[4]]
        words, at = np.unique(np.concatenate([*(p[0] for p in parts), [START]]), return_inverse=True)
        order = np.argsort(-np.bincount(at[:-1], minlength=len(words)), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        words, tokens = words[order], rank[at[:-1]]
        pairs = len(Pairs(words, tokens, sizes, np.array(held, bool)).word)
        columns = [[chunk], [[i for p in parts for i in p[3]]], [held], [sizes], [squeezed(tokens)], [packed(words)], [pairs]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in DOC_ROWS.split(", ")])

    for part in text_slices(batches, limit=SLICE):
        parts.append((*tokens_of(part.column("text")), part.column("doc_id").to_pylist(), part.column("held").to_pylist()))
        held_bytes += part.column("text").nbytes
        if held_bytes >= CHUNK_BYTES:
            yield flush()
            chunk, held_bytes, parts = chunk + 1, 0, []
    if parts:
        yield flush()


def _bucketed(rows: DataFrame, key: str, name: str) -> DataFrame:
    """A table in the shared folder, bucketed by ``key``: later steps group it without a shuffle."""
    spark, table = rows.sparkSession, f"{name}_{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").bucketBy(shuffle_partitions(spark), key).option("path", scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def cut_keys(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, last) of sorted keys; a bucket is a range of the leading 32 bits."""
    edges = np.array([-(-(i << 32) // buckets) for i in range(buckets + 1)], np.uint64)
    cuts = np.searchsorted(keys >> np.uint64(32), edges)
    for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
        yield int(b), int(cuts[b]), int(cuts[b + 1])


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The distinct pairs of a bucket with their counts in one row, and a row of places among them for each chunk."""
    words, word = np.unique(numbers(pdf["words"], steps=True), return_inverse=True)
    word = np.repeat(word, numbers(pdf["runs"]))
    contexts, context = np.unique(numbers(pdf["contexts"], steps=True), return_inverse=True)
    pairs, place = np.unique(word * len(contexts) + context, return_inverse=True)
    counts = np.bincount(place, numbers(pdf["counts"]), minlength=len(pairs))
    whole = {"bucket": int(pdf["bucket"].iloc[0]), "chunk": -1, "first": 0, "n": len(pairs), "contexts": squeezed(contexts, steps=True)}
    whole |= {"runs": squeezed(np.bincount(pairs // len(contexts))), "context": squeezed(pairs % len(contexts), steps=True), "counts": squeezed(counts)}
    ends = np.cumsum(pdf["n"].to_numpy())
    out = pdf[["bucket", "chunk", "first", "n"]].copy()
    out["place"] = [squeezed(place[e - n : e], steps=True) for e, n in zip(ends, pdf["n"], strict=True)]
    out = pd.concat([pd.DataFrame([whole]), out], ignore_index=True).reindex(columns=[c.split()[0] for c in PAIR_ROWS.split(", ")])
    return out.astype(object).where(out.notna(), None)


class Bucket:
    """All pairs of some words: words and contexts are numbered in the order of their hashes."""

    def __init__(self, pdf: pd.DataFrame):
        row = pdf[pdf["chunk"] == -1].iloc[0]
        self.number = int(row["bucket"])
        self.contexts = numbers([row["contexts"]], steps=True).astype(np.uint64) << np.uint64(16)
        self.context, self.count, runs = numbers([row["context"]], steps=True), numbers([row["counts"]]), numbers([row["runs"]])
        self.words, self.word = len(runs), np.repeat(np.arange(len(runs)), runs)
        self.seen = np.flatnonzero(self.count)
        self.word_count = np.bincount(self.word, self.count, minlength=self.words).astype(np.int64)

    def by_context(self, values: np.ndarray | None = None) -> np.ndarray:
        """Sums over the seen pairs of each context."""
        return np.bincount(self.context[self.seen], values, minlength=len(self.contexts)).astype(np.int64)


def seat(rng: np.random.Generator, customers: np.ndarray, fresh: np.ndarray, discount: float) -> np.ndarray:
    """Tables after seating all customers of each dish, one after another.

    The next customer of a dish with n seated at t tables opens a table with
    probability fresh / (n - discount t + fresh).  Beyond 64 seated customers,
    n / 32 are seated at a time by one binomial draw, so that a dish's work
    grows with the log of its customers.
    """
    order = np.argsort(-customers, kind="stable")
    c, a = customers[order], fresh[order]
    tables = np.minimum(c, 1).astype(np.int64)
    n = 1
    while len(c) and c[0] > n:
        live = np.searchsorted(-c, -n, side="left")
        step = 1 if n < 64 else n // 32
        t = tables[:live]
        p = a[:live] / (n - discount * t + a[:live])
        t += rng.random(live) < p if step == 1 else rng.binomial(np.minimum(step, c[:live] - n), p)
        n += step
    out = np.empty_like(tables)
    out[order] = tables
    return out


@dataclass
class Totals:
    """Sums over all buckets."""

    root_customers: float
    root_tables: float
    words: int
    discount: float
    root_discount: float
    strength: float = 1.0

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Predictive probability of each word in the unigram restaurant."""
        base = 1.0 / (self.words + 1)
        spare = self.strength + self.root_discount * self.root_tables
        return (np.maximum(customers - self.root_discount * tables, 0) + spare * base) / (self.strength + self.root_customers)

    def leaf(self, customers: np.ndarray, tables: np.ndarray, all_customers: np.ndarray, all_tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Predictive probability of pairs, given their contexts' totals and their words' probabilities in the parent."""
        spare = self.strength + self.discount * all_tables
        return (np.maximum(customers - self.discount * tables, 0) + spare * parent) / (self.strength + all_customers)


def _sweep(bucket: Bucket, turn: int, totals: Totals, all_tables: np.ndarray, tables: np.ndarray, root_tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([bucket.number, turn])
    seen, word, context = bucket.seen, bucket.word[bucket.seen], bucket.context[bucket.seen]
    parent = totals.root(np.bincount(word, tables, minlength=bucket.words), root_tables)
    fresh = (totals.strength + totals.discount * all_tables[context]) * parent[word]
    tables = seat(rng, bucket.count[seen], fresh, totals.discount)
    eaters = np.bincount(word, tables, minlength=bucket.words).astype(np.int64)
    spare = (totals.strength + totals.root_discount * totals.root_tables) / (totals.words + 1)
    return tables, seat(rng, eaters, np.full(len(eaters), spare), totals.root_discount)


def _sweeper(now: Totals, turn: int, parts: int):
    """Seats a bucket again; a row of tables, and a row of their sums by context for each part of the contexts."""

    def sweep(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(pdf)
        state, replies = before[before["part"] < 0], before[before["part"] >= 0].sort_values("part")
        if len(state):
            tables, root_tables = (numbers(state[c]) for c in ("tables", "root_tables"))
        else:
            tables, root_tables = np.ones(len(b.seen), np.int64), (b.word_count > 0).astype(np.int64)
        tables, root_tables = _sweep(b, turn, now, numbers(replies["tables"]), tables, root_tables)
        sums = b.by_context(tables)
        out = [(b.number, -1, squeezed(tables), squeezed(root_tables), [tables.sum(), root_tables.sum()])]
        out += [(b.number, k, squeezed(sums[x:y]), None, None) for k, x, y in cut_keys(b.contexts, parts)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in STATE_ROWS.split(", ")])

    return sweep


def _asker(parts: int):
    """What a bucket asks of each part of the contexts, and a row of its share of the first totals."""

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(pdf)
        c, contexts = b.count[b.seen], np.bincount(b.word[b.seen], minlength=b.words)
        sums = [float(v) for v in (c.sum(), len(c), (b.word_count > 0).sum(), (c == 1).sum(), (c == 2).sum(), (contexts == 1).sum(), (contexts == 2).sum())]
        customers, tables = b.by_context(c), b.by_context()
        keys = b.contexts >> np.uint64(16)
        out = [(-1, b.number, None, None, None, sums)]
        out += [(k, b.number, squeezed(keys[x:y], steps=True), squeezed(customers[x:y]), squeezed(tables[x:y]), None) for k, x, y in cut_keys(b.contexts, parts)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in ASK_ROWS.split(", ")])

    return ask


def _part(asks: pd.DataFrame) -> pd.DataFrame:
    """Where the contexts of each bucket stand among all of a part, and their totals before the first sweep."""
    asks, names = asks.sort_values("bucket", ignore_index=True), [c.split()[0] for c in PART_ROWS.split(", ")]
    if asks["part"].iloc[0] < 0:
        return asks.reindex(columns=names).astype(object).where(lambda x: x.notna(), None)
    contexts = [numbers([x], steps=True) for x in asks["contexts"]]
    found, at = np.unique(np.concatenate(contexts), return_inverse=True)
    ends = np.cumsum([len(x) for x in contexts])
    out = asks[["part", "bucket"]].copy()
    out["places"] = [squeezed(at[e - len(x) : e], steps=True) for e, x in zip(ends, contexts, strict=True)]
    for column in ("customers", "tables"):
        total = np.bincount(at, numbers(asks[column]), minlength=len(found)).astype(np.int64)[at]
        out[column] = [squeezed(total[e - len(x) : e]) for e, x in zip(ends, contexts, strict=True)]
    out["sums"] = None
    return out[names]


def _reply(asks: pd.DataFrame, swept: pd.DataFrame) -> pd.DataFrame:
    """The totals after a sweep of the contexts that each bucket asked for."""
    places = [numbers([x], steps=True) for x in asks.sort_values("bucket")["places"]]
    swept = swept.sort_values("bucket", ignore_index=True)
    total = np.bincount(np.concatenate(places), numbers(swept["tables"])).astype(np.int64)
    out = swept[["bucket", "part"]].copy()
    out["tables"] = [squeezed(total[x]) for x in places]
    return out


def score_texts(
    docs: DataFrame,
    held_out: Column,
    burn_in: int = 2,
    samples: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from the rows where ``held_out`` is false and scores all rows.
    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and one end
    for each text; null and empty texts are one end.  ``base_score`` is the
    add-0.1 unigram log10 probability, ``score`` the model's.

    Repeated rows count as often as they occur; a null ``held_out`` counts as
    held out; without any training row the model is uniform over one unknown
    word.  An empty table gives an empty result; other columns are ignored.
    Words are told apart by 48 bits of a hash within buckets of bounded load.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held"), F.col(text_col).alias("text"))
    chunks = _bucketed(rows.mapInArrow(_tokenise, DOC_ROWS), "chunk", "pitmanyor_chunks")
    number = max(1, -(-(chunks.agg(F.sum("pairs")).first()[0] or 0) // BUCKET_PAIRS))
    parts = -(-number // BUCKETS_PER_PART)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pairs, out = Pairs.of_row(batch, i), []
                keys = (pairs.words >> np.uint64(16)).astype(np.int64)
                for b, x, y in cut_keys(pairs.words[pairs.word], number):
                    heads, runs = runs_of(pairs.word[x:y])
                    words, contexts = keys[pairs.word[x:y][heads]], keys[pairs.context[x:y]]
                    cell = (squeezed(words, steps=True), squeezed(runs), squeezed(contexts, steps=True), squeezed(pairs.counts[x:y]))
                    out.append((b, batch.column("chunk")[i].as_py(), x, y - x, *cell))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SENT_ROWS.split(", ")])

    sent = chunks.select("chunk", "held", "sizes", "tokens", "words").mapInArrow(send, SENT_ROWS)
    pairs = _bucketed(sent.repartition(shuffle_partitions(spark), "bucket").groupBy("bucket").applyInPandas(_merge, PAIR_ROWS), "bucket", "pitmanyor_pairs")
    merged = pairs.where("chunk = -1").drop("place")
    asks = merged.groupBy("bucket").applyInPandas(_asker(parts), ASK_ROWS).repartition(shuffle_partitions(spark), "part")
    asks = _bucketed(asks.groupBy("part").applyInPandas(_part, PART_ROWS), "part", "pitmanyor_contexts")

    def total(df: DataFrame, size: int) -> list[float]:
        found = df.where("part < 0").agg(*(F.sum(F.col("sums")[i]) for i in range(size))).first()
        return [x or 0.0 for x in found]

    tokens, seen_pairs, words, n1, n2, w1, w2 = total(asks, 7)
    asks = asks.where("part >= 0")
    # Discounts from how many dishes were ordered once and twice.
    share = lambda once, twice: float(np.clip((once + 1) / (once + 2 * twice + 2), 0.05, 0.95))
    totals = Totals(seen_pairs, words, int(words), share(n1, n2), share(w1, w2))
    train_tokens = int(tokens)
    places = asks.select("part", "bucket", "places")
    given, kept, old = asks.select("bucket", "part", "tables", F.lit(None).cast("binary").alias("root_tables")), [], []
    for turn in range(burn_in + samples):
        swept = materialise(merged.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInPandas(_sweeper(totals, turn, parts), STATE_ROWS), "pitmanyor-state")
        root_customers, root_tables = total(swept, 2)
        totals = Totals(root_customers, root_tables, totals.words, totals.discount, totals.root_discount)
        by_context = materialise(places.groupBy("part").cogroup(swept.where("part >= 0").groupBy("part")).applyInPandas(_reply, REPLY_ROWS), "pitmanyor-totals")
        given = swept.where("part < 0").select("bucket", "part", "tables", "root_tables").unionByName(by_context.select("bucket", "part", "tables"), allowMissingColumns=True)
        for df in old:
            release(df)
        old = []
        if turn >= burn_in:
            kept.append((turn, totals, given))
        else:
            old = [swept, by_context]
    seatings = asks.select("bucket", "part", F.col("customers").alias("tables"), F.lit(-1).alias("turn"), F.lit(None).cast("binary").alias("root_tables"))
    for turn, _, more in kept:
        seatings = seatings.unionByName(more.withColumn("turn", F.lit(turn)))
    by_turn = {turn: t for turn, t, _ in kept}

    def answer(pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(pdf)
        prob = np.zeros(len(b.word))
        states = states.sort_values("part")
        of_contexts = lambda turn: numbers(states[(states["turn"] == turn) & (states["part"] >= 0)]["tables"])[b.context]
        all_customers = of_contexts(-1)
        for turn, now in by_turn.items():
            state, t = states[(states["turn"] == turn) & (states["part"] < 0)], np.zeros(len(b.word))
            t[b.seen] = numbers(state["tables"])
            root = now.root(np.bincount(b.word, t, minlength=b.words), numbers(state["root_tables"]))
            prob += now.leaf(b.count, t, all_customers, of_contexts(turn), root[b.word])
        logs = np.log10(prob / len(by_turn)).astype("<f4")
        chunk_rows = pdf[pdf["chunk"] >= 0]
        places = [numbers([p], steps=True) for p in chunk_rows["place"]]
        out = chunk_rows[["chunk", "first"]].copy()
        out["logs"] = [squeezed(logs[p].view("<u4")) for p in places]
        out["seen"] = [squeezed(b.word_count[b.word[p][runs_of(b.word[p])[0]]]) for p in places]
        return out

    answers = pairs.groupBy("bucket").cogroup(seatings.groupBy("bucket")).applyInPandas(answer, "chunk bigint, first bigint, logs binary, seen binary")
    answers = answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("first", "logs", "seen"))).alias("parts"))
    vocabulary = int(words)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pairs, parts = Pairs.of_row(batch, i), batch.column("parts")[i].as_py()
                logs = numbers(p["logs"] for p in parts).astype("<u4").view("<f4").astype(float)
                each = runs_of(pairs.word)[1]
                seen = np.repeat(numbers(p["seen"] for p in parts), each).astype(float)
                base = np.log10((seen + 0.1) / (train_tokens + 0.1 * (vocabulary + 1)))
                place = pairs.place
                sizes = pc.list_flatten(batch.column("sizes").slice(i, 1)).to_numpy()
                heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                rows = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pc.list_flatten(batch.column("ids").slice(i, 1)),
                        pc.list_flatten(batch.column("held").slice(i, 1)),
                        pa.array(sizes, pa.int64()),
                        pa.array(np.add.reduceat((seen > 0)[place].astype(np.int64), heads)),
                        pa.array(np.full(rows, train_tokens, np.int64)),
                        pa.array(np.add.reduceat(base[place], heads)),
                        pa.array(np.add.reduceat(logs[place], heads)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    joined = chunks.select("chunk", "ids", "held", "sizes", "tokens", "words").join(answers.hint("shuffle_merge"), "chunk")
    return joined.mapInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
