"""Near-duplicate vectors by E8 lattice hashing with neighbouring-cell probes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrisk.llm import hashing as H
from polyrisk.llm.common import materialise
from polyrisk.llm.components import connected_components


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    y = np.rint(x)
    odd = np.flatnonzero(y.sum(axis=1) % 2)
    gap = x[odd] - y[odd]
    worst = np.abs(gap).argmax(axis=1)
    y[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return y


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row (8 coordinates)."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


class Tables:
    """Cells of unit vectors in several tables: own cell first, then the nearest neighbouring ones."""

    def __init__(self, tables: int, probes: int, scale: float, seed: int = 5):
        self.tables, self.probes, self.scale, self.seed = tables, probes, scale, seed
        self.maps: dict[int, np.ndarray] = {}

    def cells(self, units: np.ndarray) -> np.ndarray:
        """Cell keys, rows x tables x (1 + probes)."""
        dim = units.shape[1]
        if dim not in self.maps:
            # Rows of a random rotation, as many as needed, eight for each table.
            rng, rows = np.random.default_rng(self.seed), []
            while len(rows) < 8 * self.tables:
                rows.extend(np.linalg.qr(rng.standard_normal((max(dim, 8), max(dim, 8))))[0][:, :dim])
            self.maps[dim] = np.array(rows[: 8 * self.tables]) * self.scale * np.sqrt(dim)
        out = np.empty((len(units), self.tables, 1 + self.probes), np.uint64)
        for t in range(self.tables):
            x = units @ self.maps[dim][8 * t : 8 * t + 8].T
            y = decode(x)
            # The neighbour y + r is the nearer the larger (x - y) . r is.
            best = np.argpartition(-((x - y) @ ROOTS.T), self.probes, axis=1)[:, : self.probes]
            points = np.concatenate([y[:, None, :], y[:, None, :] + ROOTS[best]], axis=1)
            codes = np.rint(2 * points).astype(np.int64).astype(np.uint64)
            out[:, t] = H.finalise((codes * H.PLACES[:8]).sum(axis=2, dtype=np.uint64) + np.uint64(t + 1) * H.PLACES[9])
        return out


def usable(vector: list | None) -> np.ndarray | None:
    """The vector in double precision, or None if it is null, empty, zero or not all finite."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, float)
    return v if np.isfinite(v).all() and v.any() else None


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    tables: int = 10,
    probes: int = 8,
    scale: float = 0.8,
    block: int = 512,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors with equal labels whose cosine (double precision) is at least
    ``threshold`` are linked if some table puts one into the other's cell or
    one of its ``probes`` nearest neighbouring cells.  Equal vectors of a
    label are one class with a weight and are never paired.  A cell with more
    than ``block`` classes is worked on in pairs of blocks, so no task gets
    more than two blocks.

    Rows whose label is null or whose vector is null, empty, zero or not
    finite link with nothing; vectors of different length don't link.  Each
    repeated row counts as one more vector, all of one class.  Rows without an
    id link like others, but have no component of their own to name (null if
    all linked ids are null) and are kept.  An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, data = [], []
            for label, vector in zip(batch.column("label").to_pylist(), batch.column("v").to_pylist(), strict=True):
                v = None if label is None else usable(vector)
                if v is None:
                    names.append(None)
                    data.append(None)
                else:
                    data.append(v.tobytes())
                    words = np.concatenate([(v + 0.0).view(np.uint64), np.frombuffer(label.encode().ljust(-(-len(label.encode()) // 8) * 8, b"\0"), np.uint64)])
                    places = H.powers(len(words) + 1)[0][1 : len(words) + 1]
                    names.append(np.array([H.finalise((H.finalise(words) * places).sum(dtype=np.uint64)[None])[0], H.finalise((H.finalise(words ^ H.PLACES[3]) * places).sum(dtype=np.uint64)[None])[0]], ">u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(names, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "label", "cls", "data"])

    named = materialise(rows.mapInArrow(name, "vec_id bigint, label string, cls binary, data binary"), "lattice-rows")
    classes = named.where("cls IS NOT NULL").groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("data").alias("data"))
    classes = materialise(classes, "lattice-classes")
    finder = Tables(tables, probes, scale)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.frombuffer(x.as_buffer(), float) for x in batch.column("data")]
            names = np.array(batch.column("cls").to_pylist(), object)
            salt = np.array([hash_label(x) for x in batch.column("label").to_pylist()], np.uint64)
            sizes = np.array([len(x) for x in data])
            for dim in np.unique(sizes):
                for at in np.array_split(np.flatnonzero(sizes == dim), max(1, int((sizes == dim).sum()) // 1000)):
                    units = np.array([data[i] for i in at])
                    units = units / np.abs(units).max(axis=1, keepdims=True)
                    units /= np.linalg.norm(units, axis=1, keepdims=True)
                    keys = H.finalise(finder.cells(units) + (salt[at] + np.uint64(dim))[:, None, None]).reshape(len(at), -1)
                    home = np.tile(np.arange(1 + probes) == 0, tables)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[at], keys.shape[1]), pa.binary()), pa.array(keys.ravel().astype(np.int64)), pa.array(np.tile(home, len(at)))], names=["cls", "key", "home"])

    placed = materialise(classes.select("cls", "label", "data").mapInArrow(place, "cls binary, key bigint, home boolean"), "lattice-cells")
    cells = placed.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("h")).where("n > 1 AND h").select("key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    met = placed.join(cells, "key").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    # Every pair of parts of a cell is one unit of work; a part joins all pairs that it is in.
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cls", "key", "home", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    met = met.join(classes.select("cls", "data"), "cls")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        names, data = pdf["cls"].to_numpy(), pdf["data"].to_numpy()
        part, home = pdf["part"].to_numpy(), pdf["home"].to_numpy(bool)
        units = np.array([np.frombuffer(x, float) for x in data])
        units = units / np.abs(units).max(axis=1, keepdims=True)
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        left, right = np.flatnonzero(part == pdf["p"].iloc[0]), np.flatnonzero(part == pdf["q"].iloc[0])
        near = (units[left] @ units[right].T >= threshold) & (home[left][:, None] | home[right][None, :])
        i, j = np.nonzero(near)
        a, b = names[left[i]], names[right[j]]
        low = a < b
        both = a != b
        return pd.DataFrame({"a": np.where(low, a, b)[both], "b": np.where(low, b, a)[both]})

    links = materialise(met.groupBy("key", "p", "q").applyInPandas(compare, "a binary, b binary").distinct(), "lattice-links")
    weight = classes.select("cls", "w")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sums = both.join(weight.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("w").alias("others"))
    roots = connected_components(links, "lattice-roots").withColumnRenamed("node", "cls")
    lows = roots.join(classes.select("cls", "rep"), "cls")
    lows = lows.join(lows.groupBy("root").agg(F.min("rep").alias("low")), "root").select("cls", "low")
    facts = classes.select("cls", "rep", "w").join(sums, "cls", "left").join(lows, "cls", "left")
    facts = facts.select("cls", (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("low", "rep").alias("low"))
    out = named.select("vec_id", "cls").join(facts, "cls", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("low", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def hash_label(label: str) -> int:
    total = 0
    for c in label.encode():
        total = (total * 257 + c + 1) % (1 << 64)
    return total
