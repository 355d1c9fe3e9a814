"""Mixing documents to target domain weights with soft domain membership."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from polyrisk.llm import hashing as H
from polyrisk.llm.common import materialise, release, text_slices

#: Hashed features of the classifier; its tables hold so many numbers per domain.
FEATURES = 1 << 16
#: Documents of a block of tokens and posteriors.
POINTS = 1 << 14
#: Bytes that belong to a plain word: ASCII letters and all of any other script.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """(sorted distinct feature numbers, white-space tokens) of each text.

    Features: the words as letters only and in lower case, the marks that
    follow a word, upper-case words, and a word that repeats the one before.
    """
    buf, offsets = H.string_buffer(column)
    tokens = np.diff(np.searchsorted(H.word_spans(buf, offsets)[0], offsets))
    owner = np.zeros(len(buf) + 1, np.int64)
    np.add.at(owner, offsets[1:-1], 1)
    owner = np.cumsum(owner)[:-1]
    found = []
    kinds = np.where(H.SPACE[buf], 0, np.where(LETTERS[buf], 1, 2)).astype(np.int8)
    if len(buf):
        change = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(owner) != 0)) + 1
        starts = np.concatenate([[0], change])
        ends = np.concatenate([change, [len(buf)]])
        kind = kinds[starts]
        hashes = H.window_hashes(H.prefix_sums(buf, H.LOWER_TABLE), starts, ends)
        word, marks = kind == 1, kind == 2
        upper = (buf >= 65) & (buf <= 90)
        total = np.concatenate([[0], np.cumsum(upper)])
        shout = word & (ends - starts > 1) & (total[ends] - total[starts] == ends - starts)
        keep = np.flatnonzero(word)
        same = np.zeros(len(starts), bool)
        same[keep[1:]] = (hashes[keep[1:]] == hashes[keep[:-1]]) & (owner[starts[keep[1:]]] == owner[starts[keep[:-1]]])
        for mask, salt in ((word, 1), (marks, 2)):
            found.append((owner[starts[mask]], H.finalise(hashes[mask] + np.uint64(salt)) >> np.uint64(48)))
        for mask, salt in ((shout, 3), (same, 4)):
            found.append((owner[starts[mask]], np.full(int(mask.sum()), int(H.finalise(np.array([salt], np.uint64))[0] >> np.uint64(48)), np.uint64)))
    if not found:
        return [np.zeros(0, np.int64)] * (len(offsets) - 1), tokens
    rows = np.concatenate([r for r, _ in found]).astype(np.uint64)
    codes = np.unique((rows << np.uint64(16)) | np.concatenate([c for _, c in found]))
    bounds = np.searchsorted(codes >> np.uint64(16), np.arange(len(offsets), dtype=np.uint64))
    plain = (codes & np.uint64(FEATURES - 1)).astype(np.int64)
    return [plain[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], tokens


@dataclass
class Classifier:
    """Presence-feature Bayes classifier, each weight shrunk towards the feature's overall rate."""

    domains: list[str]
    prior: np.ndarray
    weights: np.ndarray

    def posteriors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows x domains, tokens)."""
        sets, tokens = features(column)
        if not self.domains:
            return np.zeros((len(sets), 0)), tokens
        sizes = np.array([len(s) for s in sets])
        scores = np.tile(np.log(self.prior), (len(sets), 1))
        filled = np.flatnonzero(sizes)
        if len(filled):
            flat = np.concatenate([sets[i] for i in filled])
            scores[filled] += np.add.reduceat(self.weights[flat], np.concatenate([[0], np.cumsum(sizes[filled])[:-1]]), axis=0)
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True), tokens


def fit_classifier(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, shrink: float = 8.0) -> Classifier:
    """Fit on a bounded sample of labelled documents.

    ``labels`` has doc_id and domain; rows where either is null are left out.
    ``max_labelled`` bounds the expected number of labelled rows used (drawn by
    a hash of the id), so the broadcast of their ids is bounded, too.
    """
    labels = labels.where("doc_id IS NOT NULL AND domain IS NOT NULL").dropDuplicates(["doc_id"])
    share = min(1.0, max_labelled / max(labels.count(), 1))
    sample = labels.where(F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1_000_000)) < F.lit(share * 1_000_000))
    rows = docs.join(F.broadcast(sample), "doc_id").select("text", "domain")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in text_slices(batches):
            for domain, found in zip(part.column("domain").to_pylist(), features(part.column("text"))[0], strict=True):
                total = sums.setdefault(domain, np.zeros(FEATURES + 1, np.int64))
                total[found] += 1
                total[FEATURES] += 1
        for domain, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([domain] * len(at), pa.string()), pa.array(at), pa.array(total[at])], names=["domain", "feature", "n"])

    got = rows.mapInArrow(count, "domain string, feature bigint, n bigint").groupBy("domain", "feature").agg(F.sum("n").alias("n")).toPandas()
    domains = sorted(set(got["domain"]))
    counts = np.zeros((FEATURES + 1, len(domains)))
    counts[got["feature"], [domains.index(d) for d in got["domain"]]] = got["n"]
    size = counts[FEATURES]
    rate = (counts[:FEATURES].sum(axis=1, keepdims=True) + 0.5) / (size.sum() + 1)
    weights = np.log((counts[:FEATURES] + shrink * rate) / (size + shrink)) - np.log(rate)
    return Classifier(domains, size / max(size.sum(), 1), weights)


@dataclass
class Rates:
    """Document rates max(0, ...) reached from 1 by a fixed list of gradient steps."""

    steps: list[np.ndarray]

    def of(self, posteriors: np.ndarray) -> np.ndarray:
        x = np.ones(len(posteriors))
        for g in self.steps:
            x = np.maximum(0.0, x - posteriors @ g)
        return x


def packed_points(soft: DataFrame, k: int) -> DataFrame:
    """(n, p) of all rows of ``soft`` as binary blocks, kept in a table of their own.

    A round of :func:`fit_rates` reads these alone: without the texts beside
    them they make few files and few tasks.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            p = np.asarray(batch.column("p").flatten())
            for i in range(0, len(n), POINTS):
                blocks = [n[i : i + POINTS].tobytes(), p[i * k : (i + POINTS) * k].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blocks], names=["n", "p"])

    return materialise(soft.mapInArrow(pack, "n binary, p binary"), "mixing-points")


def _points(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, posteriors) of the documents of each block."""
    for batch in batches:
        for n, p in zip(batch.column("n"), batch.column("p"), strict=True):
            yield np.frombuffer(n.as_buffer()), np.frombuffer(p.as_buffer()).reshape(-1, k)


def fit_rates(soft: DataFrame, weights: np.ndarray, rounds: int = 60, tolerance: float = 1e-7) -> Rates:
    """Projected-gradient least squares for nonnegative rates; ``soft`` has n and p (array).

    Minimises the residual of expected domain token totals, sum of n_i x_i
    p_ik against weight_k times all tokens, in the metric in which a step of
    size one is exact while no rate is clipped at zero.  A document's rate
    depends on the steps and its own posterior only, so one round is one pass
    that returns one small vector per task; no rate is ever stored.
    """
    k = len(weights)
    points = packed_points(soft, k)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for n, p in _points(batches, k):
            total += (p * n[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["i", "v"])

    def summed(run, size: int) -> np.ndarray:
        out = np.zeros(size)
        for r in points.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out

    gram = summed(moments, k * k).reshape(k, k)
    total = gram.sum()  # posteriors sum to one, so this is the number of tokens
    if not total:
        release(points)
        return Rates([])
    metric = np.linalg.pinv(gram + 1e-9 * total * np.eye(k))
    goal, rates, before = weights * total, Rates([]), np.inf
    for _ in range(rounds):

        def expected(batches: Iterator[pa.RecordBatch], now=rates) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k)
            for n, p in _points(batches, k):
                out += (n * now.of(p)) @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(out)], names=["i", "v"])

        residual = summed(expected, k) - goal
        size = float(np.abs(residual).sum() / total)
        if size < tolerance or abs(before - size) < tolerance * 1e-2:
            break
        before = size
        rates = Rates([*rates.steps, metric @ residual])
    release(points)
    return rates


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with n_tokens, posterior (array, domains in order of name), rate and copies.

    Domains are those of ``labels`` (doc_id, domain); each needs a target
    weight, and the weights are scaled to sum to one.  The expected tokens of
    domain k over all documents at their rates match weight k times all
    tokens (as nearly as nonnegative rates can).  ``copies`` rounds the rate up
    or down by a hash of id and text, so its expectation is the rate.

    Null and empty texts have no tokens, the prior as posterior, and some
    rate that no total depends on.  Equal texts get equal rates; repeated rows
    get equal copies.  Without any label all rates are 1.  Columns of the input
    that are named like one of the results give way to it.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_tokens", "posterior", "rate", "copies")])
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit_classifier(plain, labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("domain").cast("string").alias("domain")), **options)
    missing = set(model.domains) - set(targets)
    if missing:
        raise ValueError(f"no target weight for {sorted(missing)}")
    weights = np.array([float(targets[d]) for d in model.domains])
    if (weights < 0).any() or (len(weights) and not weights.sum()):
        raise ValueError("target weights are nonnegative and not all zero")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: FEATURES rows, one column a domain
    names = docs.columns
    text_at = names.index(text_col)

    def soften(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # By place, as names may differ in case only.
            batch = pa.RecordBatch.from_arrays([*batch.columns, batch.column(text_at)], names=[*(f"c{i}" for i in range(len(names))), "text"])
            for part in text_slices([batch]):
                p, n = shared.value.posteriors(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], names=[*names, "n_tokens", "posterior"])

    # Posteriors are the dear part: they are made once, and kept with the rows that they belong to.
    schema = StructType([*docs.schema.fields, StructField("n_tokens", LongType()), StructField("posterior", ArrayType(DoubleType()))])
    soft = materialise(docs.mapInArrow(soften, schema), "mixing-soft")
    rate = F.lit(1.0)
    if model.domains:
        rates = fit_rates(soft.select(F.col("n_tokens").cast("double").alias("n"), F.col("posterior").alias("p")), weights / weights.sum())

        @F.pandas_udf("double")
        def rate_of(p: pd.Series) -> pd.Series:
            return pd.Series(rates.of(np.stack(p.to_numpy())) if len(p) else np.zeros(0))

        # So marked, a filter on copies evaluates it once a row: else each task keeps a second Python worker busy.
        rate = rate_of.asNondeterministic()("posterior")
    unit = F.pmod(F.xxhash64(F.lit(29), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = soft.withColumn("rate", rate)
    return out.withColumn("copies", (F.floor("rate") + (unit < F.col("rate") - F.floor("rate")).cast("bigint")).cast("int"))
