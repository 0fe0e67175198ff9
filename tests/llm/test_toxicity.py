import random

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm.common import text_bytes
from quadrille.llm.toxicity import fit, score, sentences, toxicity

RNG = random.Random(11)
CLEAN = [f"{a}{b}" for a in ["lo", "mi", "ta", "re"] for b in ["ran", "sel", "pun", "dor", "vek"]]
BAD = ["zurgh", "ächzorn"]


def make(n):
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        parts = [" ".join(RNG.choice(CLEAN) for _ in range(RNG.randint(2, 9))) for _ in range(RNG.randint(1, 12))]
        if toxic:
            parts[RNG.randrange(len(parts))] += f" {RNG.choice(BAD)}{RNG.choice(['', 'el', 'um'])} mi"
        rows.append((i, ". ".join(parts) + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make(600)


def test_sentences():
    data, offsets = text_bytes(pa.array(["One. Two!", "", None, "x\ny?? z"]))
    s = sentences(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(s.starts, s.ends)] == [b"One", b" Two", b"x", b"y", b" z"]
    assert s.rows.tolist() == [0, 0, 3, 3, 3]


def test_the_score_is_the_noisy_or_of_its_sentences(rows):
    model = fit(pa.chunked_array([pa.array([t for _, t, _ in rows])]), np.array([y for *_, y in rows]), {0: 450, 1: 150})
    value, s, each = model.scores(*text_bytes(pa.array([t for _, t, _ in rows] + [""])))
    for i in (0, 5, 600):
        assert value[i] == pytest.approx(1 - np.prod(1 - each[s.rows == i]))


def test_held_out_accuracy_and_places(spark, rows):
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    unseen = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([p == y for p, y in unseen]) > 0.97
    texts = {i: t for i, t, _ in rows}
    hits = [texts[i][o.start : o.end] for i, r in got.items() for o in r.offending]
    assert hits and np.mean([any(b in h for b in BAD) for h in hits]) > 0.97


def test_rows(spark, rows):
    model = fit(pa.chunked_array([pa.array([t for _, t, _ in rows])]), np.array([y for *_, y in rows]), {0: 450, 1: 150})
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "zurgh mi. loran"), (4, "zurgh mi. loran"), (4, "zurgh mi. loran"), (5, "a" * 100000)], "doc_id long, text string")
    got = sorted(map(tuple, score(docs, model).drop("offending").collect()), key=str)
    assert [r[0] for r in got] == [1, 2, 4, 4, 5, None]
    assert got[0][1] == got[1][1] == 0 and got[2] == got[3] and got[2][1] == got[5][1] > 0.3 > got[4][1]
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    # Without labels there is nothing that tells, so nothing is toxic.
    assert [(r.score, r.predicted, r.offending) for r in toxicity(docs, empty).collect()] == [(0.0, 0, [])] * 6
    assert toxicity(docs.limit(0), empty).count() == 0


def model_of(rows):
    return fit(pa.chunked_array([pa.array([t for _, t, _ in rows])]), np.array([y for *_, y in rows]), {0: 450, 1: 150})


def test_long_clean_text_is_clean_and_one_bad_sentence_in_it_tells(rows):
    model = model_of(rows)
    clean = " ".join(t for _, t, y in make(8000) if not y)
    assert len(clean) > 1_000_000
    value, *_ = model.scores(*text_bytes(pa.array([clean, clean + " mi zurgh. ta", "", "..!?"])))
    assert value[0] < 0.3 < value[1] and value[2] == value[3] == 0 and not np.signbit(value).any()


def test_clashing_columns(spark, rows):
    own = [(i, t, 9, "x", True) for i, t, _ in rows[:20]]
    docs = spark.createDataFrame(own, "doc_id long, text string, score int, predicted string, held_out boolean")
    plain = docs.select("doc_id", "text")
    assert sorted(map(str, score(docs, model_of(rows)).collect())) == sorted(map(str, score(plain, model_of(rows)).collect()))
