"""Quality classifier: supervised subword embeddings.

A document is the average of the vectors of its words, of their character n-grams (of the word between marks) and of its word bigrams,
each hashed to a bucket; bigrams of a word with itself share one bucket, so repetition is seen whatever the word. A softmax over the classes
stands on top. Vectors and output layer are learned together by stochastic gradient descent in numpy, on a bounded sample of labelled rows.
After training, bucket vectors and output layer multiply out to one class score a bucket, which is all that scoring needs.

Scale: training sees at most `max_docs` labelled documents (a parameter), whatever the corpus; scoring is one pass without a shuffle over
arrays of bytes, a slice of texts at a time.

Edge cases: a null or blank text gets the score of the output layer's bias; without labels of both classes the score is the share of
the one class seen, or 0.5; rows of one doc_id are scored each on its own; further columns are ignored or passed through by the caller.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import labelled_sample, short_batches, slices, with_fields


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dim: int = 8
    grams: tuple[int, ...] = (3, 4)
    epochs: int = 8
    least_steps: int = 4000
    rate: float = 0.6
    max_docs: int = 3000
    seed: int = 7


_U = np.uint64
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mix(h: np.ndarray, x: np.ndarray | int) -> np.ndarray:
    h = (h ^ np.asarray(x, _U)) * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(29))


def features(texts: list[str | None], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of all features of the texts; the last bucket is kept for a word that follows itself.

    The bytes of all texts stand in one array, words divided by one blank, which is the mark at both ends of a word.
    """
    raw = [(t or "").encode() for t in texts]
    codes = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    owner = np.r_[0, np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in raw])]
    codes = np.where(BLANK[codes], 32, codes)
    keep = np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]
    codes, owner = codes[keep].astype(_U), owner[keep].astype(np.int32)
    letter = codes != 32
    if not letter.any():
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    found = []
    for n in s.grams:
        parts = [codes[i : len(codes) - n + 1 + i] for i in range(n)]
        inner = np.logical_and.reduce([letter[i : len(codes) - n + 1 + i] for i in range(1, n - 1)])
        at = np.flatnonzero(inner)
        h = np.full(len(at), n, _U)
        for x in parts:
            h = _mix(h, x[at])
        found.append((owner[at + 1], h))
    # Words: a polynomial over a word's bytes.
    first = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
    last = np.flatnonzero(letter & ~np.r_[letter[1:], False])
    size = last - first + 1
    power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, _U))
    at = np.flatnonzero(letter)
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    word = _mix(np.add.reduceat(codes[at] * power[place], np.cumsum(size) - size), size.astype(_U))
    who = owner[first]
    found.append((who, _mix(word, 1)))
    same = who[1:] == who[:-1]
    found.append((who[1:][same], np.where(word[1:] == word[:-1], _U(0), _mix(_mix(word[:-1], 2), word[1:]) | _U(1))[same]))
    owners, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    # 0 is the repetition's mark, which no other feature's hash is.
    return owners, np.where(hashes == 0, s.buckets - 1, hashes % _U(s.buckets - 1)).astype(np.int32)


@dataclass
class Model:
    """score: (buckets,) difference of the two classes' scores; bias: that of the output layer."""

    score: np.ndarray
    bias: float
    settings: Settings

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, part in slices(texts):
            who, what = features(part, self.settings)
            total, n = np.bincount(who, self.score[what], len(part)), np.bincount(who, minlength=len(part))
            out[first : first + len(part)] = total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-(out + self.bias)))

    def scorer(self):
        return lambda text: float(self.probabilities([text])[0])


def train(texts: list[str], labels: list[int], s: Settings = Settings()) -> Model:
    """Fit on (text, 0 or 1) pairs."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Model(np.zeros(s.buckets, np.float32), float(np.log(share / (1 - share))), s)
    rng = np.random.default_rng(s.seed)
    docs = []
    for t in texts:
        at, n = np.unique(features([t], s)[1], return_counts=True)
        docs.append((at, (n / max(1, n.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    out, bias = np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32)
    epochs = max(s.epochs, -(-s.least_steps // len(docs)))  # few rows are seen more often
    step, steps = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            at, share = docs[i]
            rate = s.rate * (1 - step / steps)
            step += 1
            h = share @ vectors[at]
            z = h @ out + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y[i]] -= 1
            back = out @ g
            out -= rate * np.outer(h, g)
            bias -= 0.1 * rate * g
            # fastText's update: every feature moves by the whole gradient of the average.
            vectors[at] -= (rate * np.minimum(share * len(at), 4.0))[:, None] * back
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]), s)


def fit(docs: DataFrame, labels: DataFrame, label: str, s: Settings = Settings()) -> Model:
    """Fit on the texts of `docs` and the column `label` (0 or 1) of `labels`, on `max_docs` of them at most."""
    rows = labelled_sample(docs, labels, label, s.max_docs)
    return train([t for t, _ in rows], [y for _, y in rows], s)


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """`docs` with a column `into` (which replaces one of that name), the probability of class 1 for each row's whole text."""
    docs = docs.drop(into)
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.append_column(into, pa.array(shared.value.probabilities(b.column(at).to_pylist()), pa.float64()))

    return docs.mapInArrow(run, with_fields(docs, **{into: "double"}))
