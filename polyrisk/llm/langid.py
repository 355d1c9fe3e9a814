"""Language identification with segmentation-marginalised unigram models.

Every language has a probability for each piece of one fixed public
vocabulary.  A word's probability is the sum over all its segmentations into
pieces (forward algorithm); a text's is the product over its words.  Piece
probabilities are fitted by expectation maximisation on labelled texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyrisk.llm.common import materialise, release, text_slices

#: Maximal runs of letters are the words.
WORD = re.compile(r"[^\W\d_]+")
#: The vocabulary's mark for the start of a word.
MARK = "▁"
#: A longer run of letters is scored in stretches of so many (scripts without spaces).
STRETCH = 32
#: Probability of a letter that the vocabulary lacks, and the least of any piece.
UNKNOWN = 1e-7
#: Words whose scores a Python worker keeps; the store is emptied when it grows past this.
CACHE_WORDS = 200_000
UNDETERMINED = "und"


def load_pieces(path: str) -> list[str]:
    """Lower-case letter pieces (with or without the word mark) of a public piece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        letters = piece.removeprefix(MARK)
        if letters and letters == letters.lower() and WORD.fullmatch(letters) and len(piece) <= 16:
            found.add(piece)
    return sorted(found | {MARK})


class Lattice:
    """All segmentations of words into vocabulary pieces, for many words at once."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces))
        self.base = np.uint64(0x9E3779B97F4A7C15)
        keys = np.array([self._key(np.array([[ord(c) for c in p]], np.uint64))[0] for p in pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def _key(self, codes: np.ndarray) -> np.ndarray:
        key = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            key = (key + codes[:, j] + np.uint64(1)) * self.base
            key ^= key >> np.uint64(29)
        return key

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(indexes, code points with the mark in front) of words of equal length."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            for k in range(0, len(at), 20_000):
                part = at[k : k + 20_000]
                codes = np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le"), np.uint32).reshape(len(part), n)
                yield part, np.hstack([np.full((len(part), 1), ord(MARK), np.uint64), codes.astype(np.uint64)])

    def edges(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        """For each end j the (start, piece id) edges; id ``size`` is no piece, ``size + 1`` an unknown letter."""
        n, width = codes.shape
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(width + 1)]
        for start in range(width):
            key = np.zeros(n, np.uint64)
            for end in range(start + 1, min(width, start + self.longest) + 1):
                key = (key + codes[:, end - 1] + np.uint64(1)) * self.base
                key ^= key >> np.uint64(29)
                at = np.searchsorted(self.keys, key)
                at[at == self.size] = 0
                hit = self.keys[at] == key
                ids = np.where(hit, self.order[at], self.size + (end == start + 1))
                if hit.any() or end == start + 1:
                    out[end].append((start, ids))
        return out

    def log_probs(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """log P(word) by language, the forward algorithm over all segmentations.

        ``probs`` has a row for each piece, then one of zeros and one for an
        unknown letter, and a column for each language.
        """
        out = np.empty((len(words), probs.shape[1]))
        for part, codes in self.groups(words):
            width = codes.shape[1]
            alpha = [np.ones((len(part), probs.shape[1]))]
            for ends in self.edges(codes)[1:]:
                total = np.zeros((len(part), probs.shape[1]))
                for start, ids in ends:
                    total += alpha[start] * probs[ids]
                alpha.append(total)
            out[part] = np.log(alpha[width])
        return out

    def expected(self, words: list[str], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected piece counts of weighted words under one language (forward-backward)."""
        out = np.zeros(self.size + 2)
        for part, codes in self.groups(words):
            n, width = codes.shape
            edges = self.edges(codes)
            alpha, beta = np.zeros((width + 1, n)), np.zeros((width + 1, n))
            alpha[0] = beta[width] = 1.0
            for end in range(1, width + 1):
                for start, ids in edges[end]:
                    alpha[end] += alpha[start] * probs[ids]
            for end in range(width, 0, -1):
                for start, ids in edges[end]:
                    beta[start] += beta[end] * probs[ids]
            scale = weights[part] / alpha[width]
            for end in range(1, width + 1):
                for start, ids in edges[end]:
                    out += np.bincount(ids, alpha[start] * probs[ids] * beta[end] * scale, minlength=self.size + 2)
        return out


def stretches(text: str) -> list[str]:
    found = WORD.findall(text.lower())
    if any(len(w) > STRETCH for w in found):
        found = [w[k : k + STRETCH] for w in found for k in range(0, len(w), STRETCH)]
    return found


@dataclass
class Model:
    """Piece probabilities by language (``probs`` as in :meth:`Lattice.log_probs`)."""

    langs: list[str]
    prior: np.ndarray
    pieces: list[str]
    probs: np.ndarray
    lattice: Lattice | None = field(default=None, repr=False)
    known: dict[str, int] = field(default_factory=dict, repr=False)
    store: np.ndarray | None = field(default=None, repr=False)
    used: int = 0

    def __getstate__(self):
        return {"langs": self.langs, "prior": self.prior, "pieces": self.pieces, "probs": self.probs, "lattice": None, "known": {}, "store": None, "used": 0}

    def _rows(self, words: list[list[str]]) -> None:
        """Make sure that every word's scores are kept."""
        if self.lattice is None:
            self.lattice = Lattice(self.pieces)
        if len(self.known) > CACHE_WORDS or self.store is None:
            self.known.clear()
            self.store, self.used = np.zeros((4096, len(self.langs)), np.float32), 0
        fresh = list({w for text in words for w in text if w not in self.known})
        if fresh:
            need = self.used + len(fresh)
            if need > len(self.store):
                grown = np.zeros((max(need, 2 * len(self.store)), len(self.langs)), np.float32)
                grown[: self.used] = self.store[: self.used]
                self.store = grown
            self.store[self.used : need] = self.lattice.log_probs(fresh, self.probs)
            self.known.update(zip(fresh, range(self.used, need), strict=True))
            self.used = need

    def forget(self) -> None:
        """Free the kept scores: a Python worker lives on after a task and works for others."""
        self.known.clear()
        self.store = None

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, posterior) of each text; texts without letters are undetermined with score 0."""
        words = [stretches(t) for t in texts]
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, scores
        self._rows(words)
        at = [i for i, w in enumerate(words) if w]
        if at:
            flat = np.fromiter(map(self.known.__getitem__, (w for i in at for w in words[i])), np.int64)
            bounds = np.cumsum([0] + [len(words[i]) for i in at[:-1]])
            total = np.add.reduceat(self.store[flat].astype(float), bounds, axis=0) + np.log(self.prior)
            total -= total.max(axis=1, keepdims=True)
            share = np.exp(total)
            share /= share.sum(axis=1, keepdims=True)
            for i, k, s in zip(at, share.argmax(axis=1), share.max(axis=1), strict=True):
                langs[i], scores[i] = self.langs[k], s
        return langs, scores


def train(labelled: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang", max_docs: int = 20_000, rounds: int = 3) -> Model:
    """Fit piece probabilities by EM on a bounded sample of labelled texts.

    ``max_docs`` bounds the expected sample (rows are drawn by a hash of their
    text, so equal texts come together).  Word counts by language are summed
    in Spark; each EM round is one pass over them, and what comes back to the
    driver is bounded by vocabulary size times number of languages.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    share = min(1.0, max_docs / max(rows.count(), 1))
    rows = rows.where(F.pmod(F.xxhash64(F.lit(17), "text"), F.lit(1_000_000)) < F.lit(share * 1_000_000))
    pieces = load_pieces(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=8 << 20):
            seen: dict[str, Counter] = {}
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(stretches(text))
            for lang, words in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    lexicon = materialise(rows.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    totals = {r["lang"]: r["n"] for r in lexicon.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    prior = np.array([totals[x] for x in langs], float)
    prior /= max(prior.sum(), 1)
    size = len(pieces)
    # Start: a piece's share falls with its length, alike in all languages.
    start = np.array([0.1 ** min(len(p), 4) for p in pieces])
    probs = np.vstack([np.repeat((start / start.sum())[:, None], len(langs), 1), np.zeros((1, len(langs))), np.full((1, len(langs)), UNKNOWN)])
    for _ in range(rounds if langs else 0):
        now = probs

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            lattice, sums = Lattice(pieces), {}
            for batch in batches:
                lang = np.array(batch.column("lang").to_pylist(), object)
                words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy().astype(float)
                for k, name in enumerate(langs):
                    at = np.flatnonzero(lang == name)
                    if len(at):
                        sums[k] = sums.get(k, 0) + lattice.expected([words[i] for i in at], n[at], now[:, k])
            for k, total in sums.items():
                at = np.flatnonzero(total[:size] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(total[at])], names=["k", "piece", "n"])

        got = lexicon.mapInArrow(expect, "k bigint, piece bigint, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((size, len(langs)))
        counts[got["piece"], got["k"]] = got["n"]
        counts += 0.01
        probs = np.vstack([np.maximum(counts / counts.sum(axis=0), UNKNOWN), now[size:]])
    release(lexicon)
    return Model(langs, prior, pieces, probs)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score`` (posterior of the language, 0 to 1).

    Whole texts are scored, of any length.  Null or letterless texts give
    ``und`` and 0, as does every text where no language was learned; equal
    texts get equal results.  The model's size is bounded by the vocabulary.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    if {"lang_pred", "score", "__text"} & set(docs.columns):
        raise ValueError("rename the columns lang_pred and score of the input first")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            langs, scores = shared.value.predict(pc.fill_null(part.column("__text"), "").to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(langs, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"])
        shared.value.forget()

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.withColumn("__text", F.col(text_col)).mapInArrow(score, schema)


def identify(docs: DataFrame, learn: Column, vocabulary: str, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Learn from the rows where ``learn`` holds and predict every row (see :func:`train`, :func:`predict`)."""
    return predict(docs, train(docs.where(learn), vocabulary, text_col, lang_col, **options), text_col)
