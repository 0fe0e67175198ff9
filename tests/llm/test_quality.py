import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm.common import text_bytes
from quadrille.llm.quality import NEIGHBOURS, fit, keep_good, quality

RNG = random.Random(12)
WORDS = [f"{a}{b}" for a in ["lo", "mi", "ta", "re"] for b in ["ran", "sel", "pun", "dor", "vek"]]


def make(n):
    rows = []
    for i in range(n):
        words = [RNG.choice(WORDS) for _ in range(RNG.randint(8, 60))]
        if i % 5 == 0:
            words = [[w.upper() + "!!" for w in words], [w + "%%" for w in words], [words[0]] * len(words)][i % 3]
        rows.append((i, " ".join(words), int(i % 5 != 0)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make(500)


@pytest.fixture(scope="module")
def model(rows):
    return fit(pa.chunked_array([pa.array([t for _, t, _ in rows])]), np.array([y for *_, y in rows]), {0: 100, 1: 400})


def test_votes_against_brute_force(rows, model):
    vectors = model.project(model.counts(*text_bytes(pa.array([t for _, t, _ in rows[:40]] + ["", "?"]))))
    for v, got in zip(vectors, model.votes(vectors)):
        cosines = sorted(((float(n @ v), y) for n, y in zip(model.neighbours, model.labels)), key=lambda x: -x[0])[:NEIGHBOURS]
        near = [(max(c, 0), y) for c, y in cosines]
        want = sum(c * y for c, y in near) / sum(c for c, _ in near) if sum(c for c, _ in near) > 0 else 0.8
        assert got == pytest.approx(want, abs=0.1)


def test_held_out_accuracy(spark, rows):
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert np.mean([got[i].predicted == y for i, _, y in rows if got[i].held_out]) > 0.97
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.predicted)


def test_rows(spark, rows):
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    more = [(None, "LORAN!! MISEL!!"), (900, None), (901, ""), (902, "x" * 100000), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + more, "doc_id long, text string")
    got = quality(docs, labels)
    assert got.count() == len(rows) + len(more)
    assert [r.score for r in got.where("doc_id in (900, 901)").collect()] == pytest.approx([0.8, 0.8], abs=0.05)
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    assert quality(docs.limit(0), labels).count() == 0
    assert quality(docs, labels.limit(0)).where("score = 0.5").count() == len(rows) + len(more)
