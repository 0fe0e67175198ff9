"""Quality by votes of nearest neighbours in a latent-semantic space.

A document is a bag of terms: its words, the shapes of its words (letters, digits and marks as
classes, runs as one), pairs of shapes that follow each other, and words that repeat. Counts are
weighted by inverse document frequency and projected on the leading singular vectors of a bounded
sample of labelled documents. The sample's vectors are broadcast; every document's cosine with each
of them is computed exactly, in blocks of a matrix product, and its nearest labelled neighbours vote
with their cosines as weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm.common import hashes, mix, rows_of, slices, text_bytes, whole_words
from quadrille.llm.training import fold, sample

ROWS_OF_A_LABEL = 2000
TERMS = 2048
#: Documents of the sample that a term must be in.
LEAST_DOCS = 5
DIMENSIONS = 64
NEIGHBOURS = 15
THRESHOLD = 0.5
TABLE_BITS = 20
#: How many words back a word is compared with, each distance a term of its own.
REPEATS = range(1, 7)

#: Classes of bytes in a word's shape; a mark is its own class.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x30:0x3A] = ord("0")
_CLASS[0x41:0x5B] = ord("A")
_CLASS[0x61:0x7B] = ord("a")
_CLASS[0x80:] = ord("a")


def terms(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, term hash) of each term, kind by kind."""
    starts, ends = whole_words(data, offsets)
    row = rows_of(starts, offsets)
    word = hashes(data, starts, ends)
    yield row, word
    kind = _CLASS[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[starts] = True
    inside = np.zeros(len(data) + 1, np.int64)
    inside[1:] = np.cumsum(change)
    squeezed = kind[change]
    shape = hashes(squeezed, inside[starts], inside[ends]) if len(starts) else word
    shape = mix(shape ^ np.uint64(0x9E3779B97F4A7C15))
    yield row, shape
    if len(row) > 1:
        same = row[1:] == row[:-1]
        yield row[1:][same], mix(shape[:-1][same] * np.uint64(3) + shape[1:][same])
    for back in REPEATS:
        again = (row[back:] == row[:-back]) & (word[back:] == word[:-back])
        yield row[back:][again], np.full(int(again.sum()), back, np.uint64)


@dataclass
class Model:
    """Terms (sorted hashes), what each adds to a vector, the sample's unit vectors and their labels."""

    terms: np.ndarray
    vectors: np.ndarray
    neighbours: np.ndarray
    labels: np.ndarray
    prior: float

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << TABLE_BITS, bool)
        self.maybe[(self.terms & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each row's count of each of the model's terms."""
        n = len(offsets) - 1
        out = np.zeros(n * len(self.terms), np.float32)
        for row, value in terms(data, offsets):
            at = np.flatnonzero(self.maybe[(value & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)])
            if not len(at) or not len(self.terms):
                continue
            k = np.minimum(np.searchsorted(self.terms, value[at]), len(self.terms) - 1)
            good = self.terms[k] == value[at]
            out += np.bincount(row[at[good]] * len(self.terms) + k[good], minlength=len(out))
        return out.reshape(n, len(self.terms))

    def project(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts) @ self.vectors)

    def votes(self, vectors: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the nearest neighbours, blocks of rows at a time. A text
        that has no direction, or no neighbour within a right angle, gets the labels' mean."""
        out = np.full(len(vectors), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(vectors), 512):
            cosines = vectors[at : at + 512] @ self.neighbours.T
            best = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            near = np.maximum(np.take_along_axis(cosines, best, 1), 0).astype(np.float64)
            total = near.sum(1)
            some = total > 0
            out[at : at + 512][some] = ((near * self.labels[best]).sum(1)[some]) / total[some]
        return np.clip(out, 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(size > 0, size, 1)).astype(np.float32)


def fit(texts: pa.ChunkedArray, labels: np.ndarray, counts: dict[int, int]) -> Model:
    """Terms by document frequency, then the leading singular vectors of the weighted counts."""
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    each = [text_bytes(pa.array([t])) for t in texts.to_pylist()]
    # Counted block by block, so that no more than a block's terms and those kept are in memory.
    keys, many = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for at in range(0, len(each), 256):
        block = np.concatenate([np.unique(np.concatenate([v for _, v in terms(*x)])) for x in each[at : at + 256]])
        both = np.concatenate([keys, *[np.unique(block)]])
        new, inverse = np.unique(both, return_inverse=True)
        sums = np.zeros(len(new), np.int64)
        sums[inverse[: len(keys)]] += many
        unique, seen = np.unique(block, return_counts=True)
        sums[np.searchsorted(new, unique)] += seen
        keys, many = new, sums
    order = np.argsort(-many, kind="stable")[:TERMS]
    chosen = np.sort(order[many[order] >= min(LEAST_DOCS, max(1, len(each) // 4))])
    if not len(chosen):
        return Model(np.zeros(0, np.uint64), np.zeros((0, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior)
    idf = np.log(len(each) / many[chosen]) + 0.1
    model = Model(keys[chosen], np.eye(1), np.eye(1), np.zeros(1), prior)
    x = np.concatenate([np.log1p(model.counts(*e)) for e in each]) * idf.astype(np.float32)
    x = unit(x)
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    kept = np.argsort(-values)[: min(DIMENSIONS, len(values))]
    vectors = (vectors[:, kept] * idf[:, None]).astype(np.float32)
    model = Model(keys[chosen], vectors, np.zeros((0, len(kept)), np.float32), np.zeros(0), prior)
    own = np.concatenate([model.project(model.counts(*e)) for e in each])
    return Model(keys[chosen], vectors, own, labels.astype(np.float64), prior)


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, rows: int = ROWS_OF_A_LABEL) -> Model:
    """Fitted on a bounded sample (see training.sample) of labels(doc_id, quality) and docs(doc_id, text)."""
    table, counts = sample(docs, labels, "quality", folds, held_out, rows)
    return fit(table["text"], table["y"].to_numpy(), counts)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for each row of docs(doc_id, text); other columns are not looked at.
    Null and empty texts get the labels' mean. A null doc_id stays null, repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.vectors, model.neighbours, model.labels, model.prior))
    kept: dict[str, Model] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept.setdefault("model", Model(*shared.value))
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column(1))
            value = _values(own, data, offsets)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(value, pa.float64()), "predicted": pa.array((value >= threshold).astype(np.int32))})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def _values(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    parts = (_part(data, offsets, at) for at in range(0, len(offsets) - 1, 1024))
    return np.concatenate([model.votes(model.project(model.counts(*part))) for part in parts])


def _part(data: np.ndarray, offsets: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows from at on, 1024 of them at most, so that a table of counts is bounded."""
    part = offsets[at : at + 1025]
    return data[part[0] : part[-1]], part - part[0]


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """score() by a model trained here, and held_out: whether the row is in the fold kept from training."""
    found = score(docs, train(docs, labels, folds, held_out))
    return found.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose own text scores under threshold; columns stay as they are, whatever
    they are called. Rows are judged where they are read, so nothing is shuffled."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.vectors, model.neighbours, model.labels, model.prior))
    kept: dict[str, Model] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept.setdefault("model", Model(*shared.value))
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(_values(own, data, offsets) >= threshold))

    return docs.mapInArrow(run, docs.schema)
