import hashlib
import random
import re

import pytest

from quadrille.llm.secrets import BASE, RULES, Rule, redact, scan, trigram_query, trigrams


def plain(text, rules):
    found = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or ""):
            if len(m[r.group]) >= r.least:
                found.append((m.start(), k, m.end(), r.kind))
    return sorted(found)


def joined(found):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    parts = ["password", "Passwd", "SECRET", "token", "apikey", "api_KEY", "api__key", '"', "'", " ", "  ", ":", "=", "abcdefgh12", "short", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "0123456789abcdef" * 3, "é", "\U0001f600", "\n", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "x", "ſecret"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    texts += ["token = abcdefgh1 " * 500, "", None, "secret: token: abcdefgh12", "api_key==abcdefgh", "f" * 5000]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "password=abcdefghij"), (3, "token: zzzzzzzzzz"), (3, "token: zzzzzzzzzz")]


def test_queries():
    assert trigram_query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    assert trigram_query("[0-9a-f]+") == {frozenset()}
    assert trigram_query("(foo|ba)x") == {frozenset({"foo", "oox"}), frozenset({"bax"})}
    assert trigram_query("(?:abc)?def") == {frozenset({"def"})}  # what another alternative contains is left out
    assert trigram_query("(?:abcd)+z*") == {frozenset({"abc", "bcd"})}
    assert trigram_query("a.cde") == {frozenset({"cde"})}
    assert all("".join(g).islower() or "-" in g or "_" in g or " " in g for g in trigrams(RULES))
    assert len(trigram_query(BASE[0].pattern)) == 6


def test_a_match_has_its_trigrams(rows):
    for r in RULES:
        for _, text in rows:
            for m in re.finditer(r.pattern, text or ""):
                low = m[0].lower()
                assert any(all(g in low for g in q) for q in trigram_query(r.pattern))


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    got = sorted(map(tuple, scan(docs).collect()), key=str)
    want = []
    for i, text in rows:
        base, every = plain(text, BASE), plain(text, RULES)
        want.append((i, *(sum(f[1] == k for f in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
    assert got == sorted(want, key=str)
    assert scan(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_redact(spark, rows):
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_chars int")
    clean = redact(docs, "#")
    assert clean.columns == docs.columns
    want = []
    for i, text in rows:
        out, at = "", 0
        for a, _, b, _ in plain(text, RULES):
            if a >= at:
                out += text[at:a] + "#"
            at = max(at, b)
        want.append((i, text if text is None or not plain(text, RULES) else out + text[at:]))
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(want, key=str)
    assert all(r.n_chars == (7 if r.text is None else len(r.text)) for r in clean.collect())


def test_own_rules(spark):
    docs = spark.createDataFrame([(1, "id-12345 and ID-9"), (2, None)], "doc_id long, text string")
    assert [r.spans for r in scan(docs, [Rule("id", "id-[0-9]+")]).orderBy("doc_id").collect()] == ["id:0:8", ""]


def test_time_in_proportion_to_secrets(spark):
    """16,000 secrets in one text, and a long text of several blocks around few of them."""
    import time

    dense, wide = "é token = abcdefgh1 z " * 16_000, "ü" * 70_000 + " AKIA" + "B" * 20 + " ß" * 40_000 + "token: zzzzzzzzzz"
    docs = spark.createDataFrame([(1, dense), (2, wide), (3, "f" * 50_000 + "g" + "token=" + "f" * 600)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in scan(docs).collect()}
    clean = {r.doc_id: r.text for r in redact(docs, "#").collect()}
    assert time.time() - began < 60
    for i, text in docs.collect():
        assert got[i].spans == joined(plain(text, RULES))
        out, at = "", 0
        for a, _, b, _ in plain(text, RULES):
            if a >= at:
                out += text[at:a] + "#"
            at = max(at, b)
        assert clean[i] == out + text[at:]


def test_one_plan_at_every_size(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
