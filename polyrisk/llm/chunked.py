"""Whole documents as byte chunks in a bucketed table, and work on them in rounds.

The texts are moved once, when the table is written.  A round reads each chunk
with the marks that earlier rounds have made for it, and gives rows back.
"""

from __future__ import annotations

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
from polyrisk.llm.common import scratch_path, shuffle_partitions, text_slices

CHUNK_BYTES = 1 << 20
#: Text bytes that one bucket (one task of each round) holds at most, on average.
BUCKET_BYTES = 128 << 20
MARKS = "array<struct<kind:int,part:int,n:int,bits:binary>>"
MARK_ROWS = "chunk bigint, kind int, part int, n int, bits binary"
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def chunk_table(docs: DataFrame, name: str) -> str:
    """Write ``docs(doc_id, text)`` as (chunk, ids, sizes, data); the table's name.

    A chunk is about a megabyte of whole texts; a longer text is a chunk of its
    own.  The number of buckets follows the bytes of text.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for part in text_slices(batches, limit=CHUNK_BYTES):
            buf, offsets = H.string_buffer(part.column("text"))
            row = [pa.array([chunk]), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(offsets)], pa.list_(pa.int64())), pa.array([buf.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, names=["chunk", "ids", "sizes", "data"])
            chunk += 1

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, table = max(shuffle_partitions(spark), -(-size // BUCKET_BYTES)), f"{name}_{uuid.uuid4().hex}"
    rows = docs.select("doc_id", "text").mapInArrow(run, "chunk bigint, ids array<bigint>, sizes array<bigint>, data binary")
    rows.repartition(buckets, "chunk").write.option("compression", "zstd").bucketBy(buckets, "chunk").option("path", scratch_path(spark, name)).saveAsTable(table)
    return table


def drop_table(spark, table: str) -> None:
    """Drop a table of :func:`chunk_table` together with its files."""
    folder = {f.rsplit("/", 1)[0] for f in spark.table(table).inputFiles()}
    spark.sql(f"DROP TABLE {table}")
    for path in (spark._jvm.org.apache.hadoop.fs.Path(f) for f in folder):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_chunks(chunks: DataFrame, marks: DataFrame | None, schema: str, work: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """Rows that ``work`` makes of every chunk; ``row["marks"]`` are its marks so far."""
    if marks is None:
        rows = chunks.withColumn("marks", F.lit(None).cast(MARKS))
    else:
        grouped = marks.groupBy("chunk").agg(F.collect_list(F.struct("kind", "part", "n", "bits")).alias("marks"))
        rows = chunks.join(grouped.hint("shuffle_merge"), "chunk", "left")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = pa.schema([(n, ARROW[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {
                    "chunk": batch.column("chunk")[i].as_py(),
                    "ids": batch.column("ids")[i].as_py(),
                    "sizes": pc.list_flatten(batch.column("sizes").slice(i, 1)).to_numpy(),
                    "data": np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8) if len(batch.column("data")[i].as_buffer()) else np.zeros(0, np.uint8),
                    "marks": batch.column("marks")[i].as_py() or [],
                }
                out = list(work(row))
                if out:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names), schema=kinds, preserve_index=False)

    return rows.select("chunk", "ids", "sizes", "data", "marks").mapInArrow(run, schema)


def parts_of(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of its members in order) for every part number that occurs."""
    order = np.argsort(part, kind="stable")
    ordered = part[order]
    cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(part) else [0]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(ordered[i]), order[i:j]


def bits_of(row: dict, kind: int, part: np.ndarray) -> np.ndarray:
    """The marked bit of every member of ``part`` (dealt out by :func:`parts_of`)."""
    found = {m["part"]: m for m in row["marks"] if m["kind"] == kind}
    out = np.zeros(len(part), bool)
    if found:
        for p, at in parts_of(part):
            if p in found:
                out[at] = np.unpackbits(np.frombuffer(found[p]["bits"], np.uint8), count=found[p]["n"]).astype(bool)
    return out
