"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's score is a logistic function of its words and the beginnings of its words. A document is
toxic if any sentence is, so the scores are combined by noisy-or: one minus the product of what each
sentence leaves. A sentence without any of the words that tell has score 0, so however many of them a
long text has, they add nothing. Only documents have labels; the likelihood of these is what the
sentence weights are fitted to. The fitted sentence scores then tell which sentences offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import _BYTE, _P, hashes, mix, powers, rows_of, runs, slices, text_bytes
from quadrille.llm.training import ROWS_OF_A_LABEL, fold, sample

#: Features that the weights are fitted for, at most, and documents of label 1 that each must be in.
FEATURES = 4096
LEAST_DOCS = 4
#: How many times as often a feature must be in documents of label 1 as in others, and the least logarithm
#: of the odds against chance: what is a little more frequent in toxic texts only would add up in long ones.
TELLING = 4.0
AGAINST_CHANCE = 20.0
#: Bytes of the beginnings of words that are features beside the whole word.
PREFIXES = range(3, 10)
TABLE_BITS = 22
THRESHOLD = 0.3


def _folded(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, byte by byte."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 0x20
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return out


@dataclass
class Sentences:
    """A batch's sentences: the row of each, where it starts and ends in the bytes, and its features as
    (sentence, feature) pairs."""

    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def sentences(data: np.ndarray, offsets: np.ndarray) -> Sentences:
    """Runs between . ! ? and line ends; those without a letter count as well."""
    starts, ends = runs(~((data == 0x2E) | (data == 0x21) | (data == 0x3F) | (data == 0x0A) | (data == 0x0D)), offsets)
    return Sentences(rows_of(starts, offsets), starts, ends)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(where the word starts, feature) for words and their beginnings, kind by kind."""
    low = _folded(data)
    letter = ((low >= 0x61) & (low <= 0x7A)) | (low >= 0x80)
    starts, ends = runs(letter, offsets)
    yield starts, hashes(low, starts, ends)
    lengths = ends - starts
    sums, power = np.zeros(len(starts), np.uint64), powers(max(PREFIXES) + 1, _P)
    for k in range(max(PREFIXES)):
        longer = lengths > k
        starts, lengths, sums = starts[longer], lengths[longer], sums[longer]
        sums = sums + _BYTE[low[starts + k]] * power[k]
        if k + 1 in PREFIXES:
            yield starts, mix(sums ^ np.uint64(0x5851F42D4C957F2D * (k + 2) & (2**64 - 1)))


@dataclass
class Model:
    """Features (sorted hashes), a weight for each and a bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        bucket = (self.features & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
        self.maybe = np.zeros(1 << TABLE_BITS, bool)
        self.maybe[bucket] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in values that are features of the model, and which ones."""
        at = np.flatnonzero(self.maybe[(values & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)])
        if not len(at) or not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.features, values[at]), len(self.features) - 1)
        good = self.features[k] == values[at]
        return at[good], k[good]

    def bags(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Sentences, np.ndarray, np.ndarray]:
        """The sentences, and (sentence, feature number) pairs, each as often as it stands: a telling word alone may be chance, where
        several in a sentence are not."""
        s = sentences(data, offsets)
        pairs = []
        for starts, values in features(data, offsets):
            at, k = self.find(values)
            pairs.append((np.searchsorted(s.starts, starts[at], side="right") - 1) * (len(self.features) + 1) + k)
        both = np.sort(np.concatenate(pairs))
        return s, both // (len(self.features) + 1), both % (len(self.features) + 1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Sentences, np.ndarray]:
        """Each row's noisy-or, the sentences and each sentence's score."""
        s, which, k = self.bags(data, offsets)
        z = self.bias + np.bincount(which, self.weights[k], minlength=len(s.rows))
        z[np.bincount(which, minlength=len(s.rows)) == 0] = -np.inf  # no feature, score 0
        left = np.bincount(s.rows, -np.logaddexp(0, z), minlength=len(offsets) - 1)
        return np.abs(np.expm1(left)), s, 1 / (1 + np.exp(-z))


def fit(texts: pa.ChunkedArray, labels: np.ndarray, counts: dict[int, int], rounds: int = 400) -> Model:
    """Chooses the features that most tell the labels apart, then climbs the noisy-or's likelihood.
    counts: rows of each label that the texts stand for, by which documents are weighted."""
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), -20.0)
    n = np.array([(labels == y).sum() for y in (0, 1)])
    if not n[1]:
        return nothing
    each = [text_bytes(pa.array([t])) for t in texts.to_pylist()]
    found = [np.unique(np.concatenate([v for _, v in features(*x)])) for x in each]
    seen = {}
    for y in (1, 0):
        values = np.concatenate([f for f, label in zip(found, labels) if label == y] or [np.zeros(0, np.uint64)])
        if y:
            keys, many = np.unique(values, return_counts=True)
            keys, many = keys[many >= LEAST_DOCS], many[many >= LEAST_DOCS]
            seen[1] = many
        else:
            values.sort()
            seen[0] = np.searchsorted(values, keys, side="right") - np.searchsorted(values, keys)
    rate1, rate0 = (seen[1] + 0.5) / (n[1] + 1), (seen[0] + 0.5) / (n[0] + 1)
    gain = np.where(rate1 >= TELLING * rate0, seen[1] * np.log(rate1 / rate0), 0)
    best = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    best = best[gain[best] > AGAINST_CHANCE]
    model = Model(keys[best], np.zeros(len(best)), -8.0)
    if not len(best):
        return nothing
    doc, which, feature, base = [], [], [], 0
    for i, x in enumerate(each):
        s, w, k = model.bags(*x)
        doc.append(np.full(len(s.rows), i))
        which.append(w + base)
        feature.append(k)
        base += len(s.rows)
    doc, which, feature = np.concatenate(doc), np.concatenate(which), np.concatenate(feature)
    # Sentences without a feature have score 0 and no part in the likelihood.
    telling, which = np.unique(which, return_inverse=True)
    doc, base = doc[telling], len(telling)
    weight = np.array([(counts.get(int(y), 0) or 1) / n[int(y)] for y in labels])
    weight /= weight.sum()
    w, b = np.full(len(best), 0.5), -8.0
    m, v = np.zeros(len(best) + 1), np.zeros(len(best) + 1)
    for step in range(1, rounds + 1):
        z = b + np.bincount(which, w[feature], minlength=base)
        p = 1 / (1 + np.exp(-z))
        left = np.exp(np.bincount(doc, -np.logaddexp(0, z), minlength=len(each)))
        pull = np.where(labels == 1, left / np.maximum(1 - left, 1e-9), -1.0) * weight
        g = p * pull[doc]
        grad = np.append(np.bincount(feature, g[which], minlength=len(best)) - 2e-6 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
        w, b = w + move[:-1], b + move[-1]
    return Model(keys[best], w, float(b))


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, rows: int = ROWS_OF_A_LABEL) -> Model:
    """Fitted on a bounded sample (see training.sample) of labels(doc_id, toxic) and docs(doc_id, text)."""
    table, counts = sample(docs, labels, "toxic", folds, held_out, rows)
    return fit(table["text"], table["y"].to_numpy(), counts)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, locate: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, offending (start and end in code points, score: sentences that reach
    locate) for each row of docs(doc_id, text); other columns are not looked at. Null and empty texts
    have no sentence and score 0. A null doc_id stays null, repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))
    kept: dict[str, Model] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept.setdefault("model", Model(*shared.value))
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column(1))
            value, s, each = own.scores(data, offsets)
            offending: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            places = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            for i in np.flatnonzero(each >= locate):
                first = places[offsets[s.rows[i]]]
                offending[s.rows[i]].append({"start": int(places[s.starts[i]] - first), "end": int(places[s.ends[i]] - first), "score": float(each[i])})
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "score": pa.array(value, pa.float64()), "predicted": pa.array((value >= threshold).astype(np.int32)),
                "offending": pa.array(offending, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))),
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, offending array<struct<start:long,end:long,score:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """score() by a model trained here, and held_out: whether the row is in the fold kept from training."""
    found = score(docs, train(docs, labels, folds, held_out))
    return found.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", "predicted", "offending")
