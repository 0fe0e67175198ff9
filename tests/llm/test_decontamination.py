import hashlib
import random
import re

import pytest

from quadrille.llm import decontamination
from quadrille.llm.decontamination import contamination, drop_contaminated, search, search_near, written_index

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    out = []
    for doc_id, text in docs:
        ws, hit, named = words(text), set(), set()
        for name, item in items:
            iw = words(item)
            n = min(width, len(iw))
            wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    named.add(str(name) if name is not None else "null")
        out.append((doc_id, len(ws), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["a", "b", "É", "ü9", "The", "x" * 30, "日本", "c"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-!"]) for _ in range(n))
    items = [(i, sentence(rng.randint(11, 25))) for i in range(12)] + [(20, "short one"), (21, ""), (22, None), (None, "no name here"), (23, "a b"), (23, "short two")]
    docs = [(i, sentence(rng.randint(0, 80))) for i in range(40)]
    docs += [(100 + i, sentence(9) + " " + (items[i][1] or "") + " " + sentence(9)) for i in range(12)]
    docs += [(200, None), (201, ""), (202, "SHORT  one!"), (203, "short"), (204, "one"), (None, "no name here"), (205, items[0][1]), (205, items[0][1]), (206, "xx no name HERE short two")]
    return docs, items


def test_against_brute_force(spark, rows):
    docs, items = rows
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, contamination(d, b).select(columns).collect()), key=str) == brute(docs, items)
    # Small segments and blocks change nothing.
    assert sorted(map(tuple, search(written_index(d, 50), b, block_bytes=60).select(columns).collect()), key=str) == brute(docs, items)
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns
    bad = {r[0] for r in brute(docs, items) if r[-1]}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_empty_tables(spark, rows):
    docs, items = rows
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert contamination(d.limit(0), b).count() == 0
    assert contamination(d, b.limit(0)).where("contaminated").count() == 0


def test_near(spark):
    docs = [(1, "alpha x beta x gamma"), (2, "gamma beta y y y alpha"), (3, "alpha beta"), (4, "gamma"), (5, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "beta alpha"), (3, "")], "item_id long, text string")
    found = lambda span: sorted(map(tuple, search_near(written_index(d), b, span).collect()))
    assert found(5) == [(1, "1"), (1, "2"), (2, "2"), (3, "2")]
    assert found(6) == [(1, "1"), (1, "2"), (2, "1"), (2, "2"), (3, "2")]
    assert found(2) == [(3, "2")]


def test_one_very_long_text_and_many_hits(spark, rows):
    _, items = rows
    long = ("zz " * 30 + (items[0][1] or "") + " ") * 2000
    d = spark.createDataFrame([(1, long), (2, "a b " * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in contamination(d, spark.createDataFrame(items[:2] + [(23, "a b")], "item_id long, text string")).collect()}
    assert got[1].n_words == len(words(long)) and got[1].n_hit >= 2000 * len(words(items[0][1])) and "0" in got[1].items
    assert (got[2].n_hit, got[2].items, len(got[2].spans)) == (40_000, ["23"], 1)


def test_words_of_one_hash_are_different_words(spark, rows):
    """A word is looked up by its hash and then held against the word that is there."""
    docs, items = rows
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items[:6], "item_id long, text string")
    w = decontamination.windows([(i, t) for i, t in items[:6]])
    assert len(w.words) == len(set(w.words)) == len(w.terms)
    data, offsets = decontamination.text_bytes(decontamination.pa.array(["aa bb"]))
    lower, starts, ends = decontamination.cut(data, offsets)
    term = decontamination.hashes(lower, starts, ends)
    segment = decontamination.Segment([2], b"aabb", decontamination.np.array([2, 4], "<i4").tobytes(), term.tobytes(), decontamination.np.array([1, 2], "<i4").tobytes(), decontamination.np.array([0, 1], "<i4").tobytes())
    begin, end = segment.lookup(term, [b"xx", b"bb"])  # the first word has the hash of another
    assert begin.tolist() == [0, 1] and end.tolist() == [0, 2]
    assert sorted(r.doc_id for r in contamination(d, b).where("contaminated").collect()) == sorted(r[0] for r in brute(docs, items[:6]) if r[-1])
