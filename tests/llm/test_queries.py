"""Every registered query of the subpackage over whole small tables: against its SQL, a plain form, or what must hold of it."""

import hashlib
import html
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash

from quadrille.llm import queries
from quadrille.llm.bpe import read_ranks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_its_sql(spark, duck, name):
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(found.fetchall())


def labelled(duck, label, folds, held):
    known = dict(duck.execute(f"SELECT doc_id, max({label}) FROM labels WHERE {label} IS NOT NULL GROUP BY 1").fetchall())
    return {i: y for i, y in known.items() if zlib.crc32(str(i).encode()) % folds == held}


@pytest.mark.parametrize(("name", "label", "folds", "held", "least"), [("op2_toxicity", "toxic", 4, 2, 0.85), ("op9_quality", "quality", 3, 1, 0.9)])
def test_classifiers_on_what_they_did_not_see(spark, name, label, folds, held, least):
    """At sf0.01, where there are a few hundred labels."""
    sf = SF.replace("0.001", "0.01")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW labels AS SELECT * FROM '{sf}/labels.parquet'")
    n = duck.execute(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchone()[0]
    got = queries.QUERIES[name](spark, sf).collect()
    assert len(got) == n and all(0 <= r.score <= 1 and not np.signbit(r.score) for r in got)
    assert all(r.predicted == (r.score >= (0.3 if label == "toxic" else 0.5)) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in got)
    unseen = labelled(duck, label, folds, held)
    right = [r.predicted == unseen[r.doc_id] for r in got if r.doc_id in unseen]
    assert len(right) > 50 and np.mean(right) >= least


def test_simhash_against_all_pairs(spark, docs):
    def fingerprint(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: 32 for i in range(9, 14)}).split(" ")
        words = [w for w in words if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: fingerprint(t) for i, t in docs}
    root = {i: i for i in prints}
    find = lambda i: i if root[i] == i else find(root[i])
    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, SF).collect()} == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_fingerprints_against_the_plain_form(spark, docs):
    def form(t):
        for _ in range(2):
            t = unicodedata.normalize("NFKC", t).casefold()
        return " ".join(unicodedata.normalize("NFKC", t).split()).encode()

    order = sorted(((i, t or "") for i, t in docs), reverse=True)
    digest = lambda t: xxhash.xxh3_128_hexdigest(form(t))
    groups, want = {}, {}
    for i, t in order:
        groups.setdefault(form(t), []).append(i)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        n = len(t) // 3
        new = t[: len(t) - n] + after[:n]
        own, other, beside = digest(t), digest(new), digest(after)
        want[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), own, other, float(own == other), float(own == beside), min(groups[form(t)]))
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.group_id) for r in queries.op8_fingerprint(spark, SF).collect()}
    assert got == want


def test_bpe_against_the_library(spark, docs):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for i, t in docs:
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in queries.op10_byte_bpe(spark, SF).collect()} == want


def test_main_text_is_part_of_what_a_page_shows(spark, duck):
    pages = dict(duck.execute("SELECT page_id, html FROM pages").fetchall())
    got = queries.op3_html_text(spark, SF).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    full = 0
    for r in got:
        shown = re.sub(r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", " ", pages[r.page_id] or "")
        shown = "".join(html.unescape(re.sub(r"<[^>]*>", "", shown)).split())
        blocks = r.text.split("\n\n") if r.text else []
        full += bool(blocks)
        assert all("".join(b.split()) in shown and b == " ".join(b.split()) for b in blocks)
    assert full > 0.9 * len(got)
