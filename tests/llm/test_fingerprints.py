import hashlib
import random

import xxhash

from quadrille.llm.fingerprints import canonical, collisions, digest, edit_test, exact_groups


def test_canonical():
    assert canonical("  Ａb\t\nＣ ") == canonical("ab c") == b"ab c"
    assert canonical("STRASSE") == canonical("straße")
    assert canonical("é") == canonical("É")
    assert canonical(None) == canonical("") == canonical(" \n") == b""
    assert digest("x") == xxhash.xxh3_128_hexdigest(b"x")
    for text in ["ẞ", "ͅΑ", "Ω ﬁ", "Ä"]:
        assert canonical(canonical(text).decode()) == canonical(text)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (key, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        new = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        out.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), digest(text), digest(new), float(digest(text) == digest(new)), float(digest(text) == digest(after))))
    return sorted(out, key=str)


def test_edits_against_brute_force(spark):
    rng = random.Random(6)
    ids = rng.sample(range(10_000), 150)
    rows = [(i, "".join(rng.choice(["a", "B ", "é", "\U0001f600", " "]) for _ in range(rng.randint(0, 30)))) for i in ids]
    rows += [(20_000, None), (20_001, "same"), (20_002, "SAME"), (None, "no id at all")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_chars int")
    for parts in (1, 7, 64):
        assert sorted(map(tuple, edit_test(docs, parts).collect()), key=str) == brute(rows)
    for few in (rows[:1], rows[-1:], rows[:2]):
        assert sorted(map(tuple, edit_test(spark.createDataFrame(few, "doc_id long, text string"), 5).collect()), key=str) == brute(few)
    assert edit_test(docs.limit(0)).count() == 0
    # Rows of one doc_id follow each other, in a fixed order.
    twice = spark.createDataFrame([(5, "abc"), (5, "abc"), (3, "x")], "doc_id long, text string")
    assert sorted(r.near_next for r in edit_test(twice).collect()) == [0.0, 0.0, 1.0]


def test_groups(spark):
    rows = [(4, "One  two"), (2, "ONE two "), (7, None), (8, ""), (None, "one two"), (9, "other"), (None, "alone"), (9, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.group_id) for r in exact_groups(docs).collect()), key=str)
    assert got == sorted([(4, 2), (2, 2), (7, 7), (8, 7), (None, 2), (9, 9), (None, None), (9, 9)], key=str)
    assert exact_groups(docs.limit(0)).count() == 0


def test_equal_digests_of_different_texts_are_kept_apart(spark):
    poor = lambda text: str(len(canonical(text)))
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "AA"), (4, "c"), (5, "C")], "doc_id long, text string")
    assert [r.fingerprint for r in collisions(docs, poor).collect()] == ["2"]
    assert sorted((r.doc_id, r.group_id) for r in exact_groups(docs, poor).collect()) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 4)]
