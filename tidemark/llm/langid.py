"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the character n-grams (1 to 3) of lower-cased words' letters between edge marks, hashed; a document's value is its share of the
n-gram times the n-gram's inverse document frequency. Weights are learned by follow-the-regularised-leader (FTRL-proximal) with
elastic-net penalties, so most are exactly 0; a temperature, fitted on rows that training left aside, calibrates the probabilities.

Scale: training sees at most `max_docs` rows (a parameter), as even over the languages as they allow, so rare ones are learned too; scoring is one
pass without a shuffle over arrays of code points, a slice of texts at a time.

Edge cases: a text that is null or has no letter is `und` with score 0; so is every text if nothing was learned; rows with a null
language are never learned from; ties go to the language that comes first in code point order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sample_of, short_batches, slices, with_fields


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    grams: tuple[int, ...] = (1, 2, 3)
    scale: float = 50.0
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 3
    max_docs: int = 3000
    seed: int = 9


@cache
def kinds() -> np.ndarray:
    """For each code point: 1 a letter, 2 a blank (as bytes.split() has them), 0 anything else."""
    out = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), np.uint8, 0x110000)
    out[[9, 10, 11, 12, 13, 32]] = 2
    return out


def features(texts: list[str | None], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram of the texts, in the order of the texts for each length of n-gram.

    The letters of all texts stand in one array, words divided by one 0, which is the edge mark; an n-gram lies in one word, so only its ends may be marks.
    """
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    owner = np.r_[0, owner, len(texts) - 1][: len(codes)]
    kind = kinds()[codes]
    keep = kind > 0
    codes, owner = np.where(kind[keep] == 2, 0, codes[keep]).astype(np.uint64), owner[keep]
    keep = np.r_[True, (codes[1:] > 0) | (codes[:-1] > 0)][: len(codes)]
    codes, owner = codes[keep], owner[keep]
    who, what = [], []
    for n in s.grams:
        parts = [codes[i : len(codes) - n + 1 + i] for i in range(n)]
        inner = np.ones(len(parts[0]), bool)
        for x in parts[1:-1] if n > 1 else parts:
            inner &= x > 0
        if n == 2:
            inner &= (parts[0] > 0) | (parts[1] > 0)
        at = np.flatnonzero(inner)
        h = np.full(len(at), n, np.uint64)
        for x in parts:
            h = (h ^ x[at]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        # A pair that begins with a mark belongs to the text of its letter; the second place of a longer one is a letter.
        own = owner[at] if n == 1 else np.where(codes[at] > 0, owner[at], owner[at + 1])
        who.append(own)
        what.append((h % np.uint64(s.buckets)).astype(np.int32))
    return np.concatenate(who), np.concatenate(what)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (buckets, langs), with inverse document frequency and scale multiplied in
    bias: np.ndarray
    temperature: float
    settings: Settings

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        if not self.langs:
            return out
        for first, part in slices(texts):
            who, what = features(part, self.settings)
            n = np.bincount(who, minlength=len(part))
            total = np.zeros((len(part), len(self.langs)))
            cuts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]][: len(who)])  # a text's n-grams of one length stand together
            if len(cuts):
                np.add.at(total, who[cuts], np.add.reduceat(self.weights[what], cuts, axis=0, dtype=np.float64))
            z = (total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
            best, p = z.argmax(1), _softmax(z).max(1)
            for i in np.flatnonzero(n):
                out[first + i] = (self.langs[best[i]], float(p[i]))
        return out

    def predictor(self):
        return lambda text: self.predict([text])[0]


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def train(texts: list[str], labels: list[str], s: Settings = Settings()) -> Model:
    """Fit on (text, language) pairs."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((s.buckets, 0), np.float32), np.zeros(0), 1.0, s)
    rng = np.random.default_rng(s.seed)
    docs, df = [], np.zeros(s.buckets)
    for t in texts:
        at, n = np.unique(features([t], s)[1], return_counts=True)
        df[at] += 1
        docs.append((at, n / max(1, n.sum())))
    idf = np.log((1 + len(docs)) / (1 + df)) + 1
    docs = [(at, share * idf[at] * s.scale) for at, share in docs]
    y = np.array([langs.index(x) for x in labels])
    aside = rng.random(len(docs)) < 0.2
    z, n = np.zeros((s.buckets, len(langs))), np.zeros((s.buckets, len(langs)))
    zb, nb = np.zeros(len(langs)), np.zeros(len(langs))

    def leader(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for i in rng.permutation(np.flatnonzero(~aside)):
            at, x = docs[i]
            w, b = leader(z[at], n[at], s.l1), leader(zb, nb, 0.0)
            g = _softmax(x @ w + b)
            g[y[i]] -= 1
            gw = x[:, None] * g
            z[at] += gw - (np.sqrt(n[at] + gw**2) - np.sqrt(n[at])) / s.alpha * w
            n[at] += gw**2
            zb += g - (np.sqrt(nb + g**2) - np.sqrt(nb)) / s.alpha * b
            nb += g**2
    w, bias = leader(z, n, s.l1), leader(zb, nb, 0.0)
    logits = np.array([x @ w[at] + bias for (at, x), out in zip(docs, aside, strict=True) if out])
    temperature = 1.0
    if len(logits):
        grid = np.geomspace(0.1, 10, 60)
        temperature = float(min(grid, key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(logits)), y[aside]] + 1e-12).mean()))
    return Model(langs, (w * (idf * s.scale)[:, None]).astype(np.float32), bias, temperature, s)


def fit(labelled: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on a frame with text and lang, on at most `max_docs` of its distinct rows."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = sample_of(labelled, "lang", ["text", "lang"], s.max_docs)
    return train([t for t, _ in rows], [x for _, x in rows], s)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score, the probability of that language."""
    docs = docs.drop("lang_pred", "score")
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            found = shared.value.predict(b.column(at).to_pylist())
            b = b.append_column("lang_pred", pa.array([x[0] for x in found], pa.string()))
            yield b.append_column("score", pa.array([x[1] for x in found], pa.float64()))

    return docs.mapInArrow(run, with_fields(docs, lang_pred="string", score="double"))
