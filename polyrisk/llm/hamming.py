"""Exact top-k Hamming search with incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyrisk.llm.common import materialise

SEGMENT_BITS = 16
_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << SEGMENT_BITS)], np.uint8)
_masks: dict[int, np.ndarray] = {}


def masks(radius: int) -> np.ndarray:
    """All segment values with ``radius`` bits set."""
    if radius not in _masks:
        _masks[radius] = np.array([sum(1 << b for b in bits) for bits in combinations(range(SEGMENT_BITS), radius)], np.uint16)
    return _masks[radius]


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code): one bit a component (1 if positive), in whole 16-bit segments; null vectors have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for v in batch.column("v").to_pylist():
                bits = np.array([x is not None and x > 0 for x in v], bool)
                codes.append(np.packbits(np.concatenate([bits, np.zeros(-len(bits) % SEGMENT_BITS, bool)])).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes, pa.binary())], names=["id", "code"])

    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    return rows.where("id IS NOT NULL AND size(v) > 0").mapInArrow(run, "id bigint, code binary")


class Shard:
    """Segment tables over some codes of equal length."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.codes = ids, codes  # codes: rows x segments, uint16
        self.orders = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.tables = []
        for j, order in enumerate(self.orders):
            values, starts = np.unique(codes[order, j], return_index=True)
            self.tables.append((values, starts, np.diff(np.append(starts, len(order)))))

    def bucket_hits(self, j: int, radius: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, bucket) of the buckets at exactly ``radius`` bits in segment j."""
        values = self.tables[j][0]
        flips = masks(radius)
        if len(flips) < len(values):
            probes = wanted[:, None] ^ flips[None, :]
            at = np.searchsorted(values, probes)
            at[at == len(values)] = 0
            q, f = np.nonzero(values[at] == probes)
            return q, at[q, f]
        return np.nonzero(_POPCOUNT[wanted[:, None] ^ values[None, :]] == radius)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, row, distance): every row up to the k-th distance of each query.

        Segment j is searched at radius r after all segments at r - 1 and
        those before j at r.  A row not seen by then differs in more than
        m * r + j bits, so a query is done when its k-th verified distance is
        no larger.  The query's own id doesn't count.
        """
        n, m = queries.shape
        live = np.arange(n)
        seen = np.zeros((n, m * SEGMENT_BITS + 1), np.int64)
        out = []
        for radius in range(SEGMENT_BITS + 1):
            for j in range(m):
                if not len(live):
                    break
                q, bucket = self.bucket_hits(j, radius, queries[live, j])
                _, starts, sizes = self.tables[j]
                size = sizes[bucket]
                place = np.repeat(starts[bucket] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                row, q = self.orders[j][place], live[np.repeat(q, size)]
                apart = _POPCOUNT[self.codes[row] ^ queries[q]]
                # Each pair is verified where it is met first.
                first = (apart[:, :j] > radius).all(axis=1) & (apart[:, j + 1 :] >= radius).all(axis=1) & (self.ids[row] != query_ids[q])
                q, row, distance = q[first], row[first], apart[first].sum(axis=1, dtype=np.int64)
                np.add.at(seen, (q, distance), 1)
                out.append((q, row, distance))
                covered = m * radius + j
                live = live[seen[live, : covered + 1].sum(axis=1) < k]
        q, row, distance = (np.concatenate(x) for x in zip(*out, strict=True))
        reached = seen.cumsum(axis=1) >= k
        limit = np.where(reached.any(axis=1), reached.argmax(axis=1), seen.shape[1])
        near = distance <= limit[q]
        return q[near], row[near], distance[near]


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 32_768, block_rows: int = 1_024) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the exact k nearest codes of every query.

    ``index`` and ``queries`` are (id, code) with codes as whole 16-bit
    segments.  Every block of queries meets every shard of the index; shard
    and block sizes are fixed, so their numbers grow with the data, and each
    shard returns k rows a query, merged by a window per query.  Ties go to the
    smaller id; a query's own id is no neighbour of it.  Rows that repeat an id
    count once (the smallest code); null ids, null codes and codes of another
    length than the query's are not compared, so fewer than k rows may come.
    """
    spark = index.sparkSession
    clean = lambda df: df.where("id IS NOT NULL AND code IS NOT NULL").groupBy("id").agg(F.min("code").alias("code"))
    index = materialise(clean(index), "hamming-index")
    queries = materialise(clean(queries), "hamming-queries")
    shards, blocks = (max(1, -(-df.count() // size)) for df, size in ((index, shard_rows), (queries, block_rows)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = index.withColumn("shard", deal(shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", deal(blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "neighbor_id": np.zeros(0, np.int64), "distance": np.zeros(0, np.int32)})]
        for width, part in asked.groupby(asked["code"].str.len()):
            same = rows[rows["code"].str.len() == width]
            if len(same):
                code = lambda df: np.frombuffer(b"".join(df["code"]), ">u2").astype(np.uint16).reshape(len(df), -1)  # noqa: B023, E731
                ids = part["id"].to_numpy()
                shard = Shard(same["id"].to_numpy(), code(same))
                for at in range(0, len(part), 128):
                    q, row, distance = shard.search(ids[at : at + 128], code(part.iloc[at : at + 128]), k)
                    found = pd.DataFrame({"query_id": ids[at : at + 128][q], "neighbor_id": shard.ids[row], "distance": distance.astype(np.int32)})
                    out.append(found.sort_values(["query_id", "distance", "neighbor_id"]).groupby("query_id").head(k))
        return pd.concat(out)

    near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(run, "query_id bigint, neighbor_id bigint, distance int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
