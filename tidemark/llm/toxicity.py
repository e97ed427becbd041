r"""Toxicity: a support vector machine with a gapped subsequence kernel and Nyström landmarks.

A sentence's units are its words: letters only, lower-cased, digits that stand for letters replaced, and single letters in a row
joined, so `i.d.i.0.t` and `i d i o t` are one unit. The kernel of two units counts common subsequences of three letters; each occurrence
may stretch over up to six letters and loses weight `decay` for each letter it skips, so units with inserted or missing letters stay
close. A unit is mapped to its kernel values with the landmark units, whitened by the landmarks' own kernel matrix (Nyström),
and a linear SVM stands on that. Labels are of documents, whose sentences inherit them: in each toxic one, the unit that looks most
toxic is the witness (first by document frequencies, then by the SVM itself), and clean units that score high are added as
hard negatives. A document's score is a logistic function of its highest unit scores.

As the kernel's features are explicit, the trained expansion over landmarks multiplies out to one weight a subsequence: a unit is scored by
table look-ups, once for each distinct word of a worker.

Scale: training sees at most `max_docs` labelled documents (a parameter); scoring is one pass without a shuffle.

Edge cases: null and blank texts, and texts without a word of three letters, get the score of a document whose units are all far from toxic;
without labels of both classes every score is 0; rows of one doc_id are scored each on its own.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import labelled_sample, short_batches, with_fields
from tidemark.llm.words import WordTable

SPAN, SYMBOLS, GRAM = 5, 32, 3
FLOOR = -3.0
SPELLED = re.compile(rb"(?<![a-z0-9\x80-\xff])(?:[a-z0-9][\s.,*_\-]{1,2}){2,}[a-z0-9](?![a-z0-9\x80-\xff])")
SENTENCE = re.compile(rb"[.!?\n]+(?=\s|$)")
#: a-z are 1 to 26; digits as the letters they stand for; other bytes of letters beyond ASCII share 27 to 31; the rest is dropped.
CODES = np.zeros(256, np.uint8)
CODES[97:123] = np.arange(1, 27)
for digit, letter in zip(b"013457", b"oieast", strict=True):
    CODES[digit] = letter - 96
CODES[128:192] = 27 + np.arange(64) % 5
DROPPED = bytes(i for i in range(256) if not CODES[i])
PLACES = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]


@dataclass(frozen=True)
class Settings:
    decay: float = 0.5
    landmarks: int = 160
    rounds: int = 3
    negatives: int = 20_000
    max_docs: int = 4000
    seed: int = 3


def sentences(text: str | None) -> list[list[bytes]]:
    """Units of each sentence."""
    out = []
    for part in SENTENCE.split((text or "").encode().lower()):
        words = part.split()
        if sum(len(w) == 1 for w in words) > 2 or re.search(rb"[a-z0-9][.,*_\-][a-z0-9]", part):
            words += [m[0] for m in SPELLED.finditer(part)]
        out.append([u for w in words if len(u := w.translate(None, DROPPED)) >= GRAM])
    return [x for x in out if x]


def document_units(text: str | None) -> list[bytes]:
    """All units of a text; as sentences(), without the borders."""
    data = (text or "").encode().lower()
    words = data.split()
    if words and (data.count(b" ") * 2 > len(data) * 0.6 or SPELLED.search(data)):
        words += [m[0] for m in SPELLED.finditer(data)]
    return words


def occurrences(units: list[bytes], decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit number, feature, weight) of every subsequence occurrence, and each unit's norm."""
    clean = [u.translate(None, DROPPED) for u in units]
    size = np.array([len(u) for u in clean], np.int64)
    raw = np.frombuffer(b"".join(u + b"\0" * SPAN for u in clean), np.uint8)
    code, owner = CODES[raw].astype(np.int32), np.repeat(np.arange(len(units)), size + SPAN)
    who, what, weight = [], [], []
    for a, b in PLACES:
        third = code[b:]
        ok = np.flatnonzero(third)
        ok = ok[code[ok] > 0]
        who.append(owner[ok])
        what.append(code[ok] * (SYMBOLS * SYMBOLS) + code[ok + a] * SYMBOLS + code[ok + b])
        weight.append(np.full(len(ok), decay ** (b - 2), np.float32))
    who, what, weight = (np.concatenate(x) if x else np.zeros(0) for x in (who, what, weight))
    norm = np.sqrt(np.bincount(who, weight**2, len(units)))
    return who, what, weight, np.maximum(norm, 1e-6)


@dataclass
class Model:
    weights: np.ndarray  # one for each subsequence of three symbols
    bias: float
    output: np.ndarray  # logistic weights of (highest, mean of the three highest, 1)
    settings: Settings

    def unit_scores(self, units: list[bytes]) -> np.ndarray:
        if not units:
            return np.zeros(0)
        who, what, weight, norm = occurrences(units, self.settings.decay)
        return np.bincount(who, weight * self.weights[what], len(units)) / norm + self.bias

    def rows_of(self, words: list[bytes]) -> np.ndarray:
        short = np.array([len(w.translate(None, DROPPED)) < GRAM for w in words])
        return np.where(short, FLOOR, np.maximum(self.unit_scores(words), FLOOR)).astype(np.float32)[:, None]

    def probability(self, scores: np.ndarray) -> float:
        z = float(self.output @ summary(scores))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def scorer(self):
        table = WordTable(self.rows_of)

        def one(text: str | None) -> float:
            units = document_units(text)
            return self.probability(table.take(units)[:, 0] if units else np.zeros(0))

        return one


def summary(scores: np.ndarray) -> np.ndarray:
    top = np.sort(np.append(scores[scores > FLOOR], [FLOOR] * 3))[-3:] if len(scores) < 200 else np.partition(scores, -3)[-3:]
    return np.array([top.max(), top.mean(), 1.0])


def train(texts: list[str], labels: list[int], s: Settings = Settings()) -> Model:
    """Fit on (text, 0 or 1) pairs."""
    zero = Model(np.zeros(SYMBOLS**GRAM, np.float32), -1.0, np.array([0.0, 0.0, -30.0]), s)
    if len(set(labels)) < 2:
        return zero
    rng = np.random.default_rng(s.seed)
    y = np.array(labels)
    bags = [[u for part in sentences(t) for u in set(part)] for t in texts]
    seen = [Counter(u for b, label in zip(bags, labels, strict=True) if label == c for u in set(b)) for c in (0, 1)]
    n = [max(1, int((y == c).sum())) for c in (0, 1)]
    odds = {u: np.log((k + 0.1) / n[1]) - np.log((seen[0][u] + 0.5) / n[0]) for u, k in seen[1].items() if k > 1}
    toxic = [b for b, label in zip(bags, labels, strict=True) if label == 1 and b]
    clean = list(seen[0])
    if not odds or not clean:
        return zero
    ranked = sorted(odds, key=lambda u: (-odds[u] * np.log1p(seen[1][u]), u))
    others = [clean[i] for i in rng.permutation(len(clean))[: s.landmarks // 2]]
    landmarks = list(dict.fromkeys(ranked[: s.landmarks // 2] + others))

    def dense(units: list[bytes]) -> np.ndarray:
        who, what, weight, norm = occurrences(units, s.decay)
        out = np.zeros((len(units), SYMBOLS**GRAM), np.float32)
        np.add.at(out, (who, what), weight)
        out /= norm[:, None].astype(np.float32)
        return out

    marks = dense(landmarks)
    values, axes = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    white = axes[:, keep] / np.sqrt(values[keep])

    def mapped(units: list[bytes]) -> np.ndarray:
        return np.concatenate([(dense(units[i : i + 250]) @ marks.T).astype(np.float64) @ white for i in range(0, len(units), 250)])

    # Witnesses are counted by how many toxic documents they speak for.
    witness = Counter(max(b, key=lambda u: (odds.get(u, -9.0), u)) for b in toxic)
    negatives = [clean[i] for i in rng.permutation(len(clean))[: s.negatives]]
    weights, bias = np.zeros(SYMBOLS**GRAM, np.float32), 0.0
    for _ in range(s.rounds):
        pos = [u for u in witness if seen[0][u] * n[1] < witness[u] * n[0]]
        if not pos:
            return zero
        x = np.concatenate([mapped(pos), mapped(negatives)])
        t = np.r_[np.ones(len(pos)), -np.ones(len(negatives))]
        cost = np.r_[np.array([witness[u] for u in pos], float) ** 0.5, np.ones(len(negatives))]
        cost[: len(pos)] *= 0.5 / cost[: len(pos)].sum()
        cost[len(pos) :] *= 0.5 / cost[len(pos) :].sum()
        w, b = np.zeros(x.shape[1]), 0.0
        for step in range(400):  # squared hinge by momentum-free gradient descent; the scale of x is about 1
            short = np.maximum(0, 1 - t * (x @ w + b)) * t * cost
            w += 2.0 * (short @ x - 1e-4 * w)
            b += 2.0 * short.sum()
        weights, bias = (marks.T @ (white @ w)).astype(np.float32), float(b)
        model = Model(weights, bias, zero.output, s)
        f = model.unit_scores(clean)
        hard = np.argsort(-f)[: s.negatives // 10]
        negatives = list(dict.fromkeys([clean[i] for i in hard if f[i] > -0.9] + negatives))
        scored = dict(zip(seen[1], model.unit_scores(list(seen[1])), strict=True))
        witness = Counter(max(b, key=lambda u: (scored[u] + 0.2 * np.tanh(odds.get(u, -5.0)), u)) for b in toxic)
    z = np.array([summary(model.rows_of(b)[:, 0] if b else np.zeros(0)) for b in bags])
    out = np.zeros(3)
    for _ in range(50):  # Newton steps of a lightly penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ out, -30, 30)))
        out += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(3), z.T @ (y - p) - 1e-2 * out)
    return Model(weights, bias, out, s)


def fit(docs: DataFrame, labels: DataFrame, label: str, s: Settings = Settings()) -> Model:
    """Fit on the texts of `docs` and the column `label` (0 or 1) of `labels`, on `max_docs` of them at most."""
    rows = labelled_sample(docs, labels, label, s.max_docs)
    return train([t for t, _ in rows], [y for _, y in rows], s)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with a column `score`, the probability that a row's whole text is toxic."""
    docs = docs.drop("score")
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        one = shared.value.scorer()
        for b in batches:
            yield b.append_column("score", pa.array([one(t) for t in b.column(at).to_pylist()], pa.float64()))

    return docs.mapInArrow(run, with_fields(docs, score="double"))
