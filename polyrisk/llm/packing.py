"""Vector best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrisk.llm.common import materialise, text_slices

#: Units whose token ids a Python worker keeps (the store is emptied when it is full), and the longest of them.
CACHE_UNITS, CACHE_CHARS = 100_000, 64

# Fixed value: how a byte-level vocabulary of this kind cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def load_encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids for a byte-level tokenizer file.

    Where ids follow the order of the file's merges, the same vocabulary runs
    in the faster of the two public libraries (equal ids, see the tests).
    """
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    spec = json.loads(tokenizer.to_str())
    model, names = spec["model"], byte_names()
    vocab, special = model.get("vocab"), {x["content"] for x in spec.get("added_tokens") or []}
    merged = [x if isinstance(x, list) else x.split(" ") for x in model.get("merges") or []]
    plain = spec.get("pre_tokenizer") == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if model.get("type") == "BPE" and plain and not spec.get("normalizer"):
        ranks = {bytes(names[c] for c in token): i for token, i in vocab.items() if token not in special}
        if [vocab[a + b] for a, b in merged] == list(range(256, 256 + len(merged))) and len(ranks) == 256 + len(merged):
            return tiktoken.Encoding("from_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


class _Units(dict):
    """Token bytes (little-endian uint32) of a space plus a unit, made when first asked for.

    A Python worker lives on after a task and works for others, so what it
    keeps is bounded at every moment, in number and in length.
    """

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def ids(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def __missing__(self, unit: str) -> bytes:
        found = self.ids(" " + unit)
        if len(unit) <= CACHE_CHARS:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[unit] = found
        return found


_units: dict[str, _Units] = {}
#: A space with white space (or an end of the text) on both sides.
_LONE_SPACE = re.compile(r"\s[ ](?=\s|$)|^[ ](?=\s|$)")
_SPACE_FIRST = re.compile(r" (?:\s|$)")  # cheaper, and true wherever the other one is


def tokenise(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts by the tokenizer file at ``path``, as little-endian uint32 bytes.

    The vocabulary's pre-tokenizer never joins a space to what stands before
    it, unless white space stands on both sides of that space.  So a text is
    the concatenation of its units (cut before each space), whose ids are kept
    by unit; texts with a space between other white space are encoded whole.
    """
    if path not in _units:
        _units[path] = _Units(load_encoder(path))
    units, out = _units[path], []
    for text in texts:
        if _SPACE_FIRST.search(text) and _LONE_SPACE.search(text):
            out.append(units.ids(text))
        else:
            head, *rest = text.split(" ")
            out.append((units.ids(head) if head else b"") + b"".join(map(units.__getitem__, rest)))
    return out


def piece_table(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: a document's ids plus ``end_id``, cut only when longer than ``capacity``.

    The first piece takes what is left over, so that all others are full.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for part in text_slices(batches):
            texts = pc.fill_null(part.column("text"), "").to_pylist()
            ids, rows = part.column("doc_id").to_pylist(), []
            for doc_id, data in zip(ids, tokenise(texts, path), strict=True):
                data += end
                n, at, piece = len(data) // 4, 0, 0
                while at < n:
                    length = (n - at) % capacity or capacity
                    rows.append((doc_id, piece, at, length, zlib.crc32(data[4 * at : 4 * (at + length)])))
                    at, piece = at + length, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_attention: float, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item by vector best-fit decreasing.

    An item needs (tokens, one document, tokens**2 of attention); a bin has a
    residual of each.  Among the open bins where all three fit, the item goes
    to the one with the smallest weighted residual norm left (``rule="norm"``)
    or the largest weighted dot product of residual and need (``"dot"``); ties
    go to the oldest bin.  An item that fits nowhere opens a bin.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room = np.zeros((3, max(n, 1)))  # residual share of each capacity, by open bin
    name = np.zeros(max(n, 1), np.int64)
    full = np.array([capacity, max_docs, max_attention], float)
    w = np.array(weights, float)
    opened = live = 0
    for i in order:
        length = int(lengths[i])
        need = np.array([length, 1.0, float(length) ** 2]) / full
        best = -1
        if live:
            r = room[:, :live]
            fits = (r >= need[:, None] - 1e-12).all(axis=0)
            if rule == "norm":
                left = r - need[:, None]
                score = np.where(fits, w @ (left * left), np.inf)
                best = int(score.argmin())
                best = best if fits[best] else -1
            else:
                score = np.where(fits, (w * need) @ r, -np.inf)
                best = int(score.argmax())
                best = best if fits[best] else -1
        if best < 0:
            best, name[live] = live, opened
            room[:, live] = 1.0
            opened, live = opened + 1, live + 1
        bins[i] = name[best]
        offsets[i] = capacity - round(room[0, best] * capacity)
        room[:, best] -= need
        if (room[:, best] * full < 1 - 1e-6)[:2].any():  # no token or document more
            live -= 1
            room[:, best : live] = room[:, best + 1 : live + 1]
            name[best:live] = name[best + 1 : live + 1]
    return bins, offsets


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = 1024,
    end_id: int = 2,
    max_docs: int = 1024,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
    rule: str = "norm",
    group_pieces: int = 12_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Pieces are dealt by a hash of their row to groups of about
    ``group_pieces``, each packed on its own by :func:`best_fit`; a sequence id
    is the group's number and the bin's.  A group's size does not grow with
    the data (their number does), so a hot key or many equal texts spread too;
    the price is at most one partly filled bin per group.  ``max_attention``
    (sum of squared piece lengths in a sequence) is ``capacity**2`` by default.

    Null and empty texts are one piece with the end id alone.  Repeated rows
    and repeated or null ids are packed row by row.  An empty table gives an
    empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    if max_docs < 1 or (max_attention or capacity**2) < capacity**2:
        raise ValueError("a full piece must fit into a sequence")
    if rule not in ("norm", "dot"):
        raise ValueError("rule is 'norm' or 'dot'")
    attention = float(max_attention or capacity**2)
    pieces = piece_table(docs, path, capacity, end_id, id_col, text_col)
    pieces = materialise(pieces.withColumn("row_id", F.monotonically_increasing_id()), "pack-pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id", kind="stable")
        bins, offsets = best_fit(pdf["length"].to_numpy(), capacity, max_docs, attention, weights, rule)
        return pdf.assign(sequence_id=(pdf["grp"].to_numpy() << 32) + bins, offset=offsets)[[c.split()[0] for c in PACKED.split(", ")]]

    return pieces.withColumn("grp", F.pmod(F.xxhash64("row_id"), F.lit(groups))).groupBy("grp").applyInPandas(fill, PACKED)
