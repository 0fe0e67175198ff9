import re

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from quadrille.llm import quality, secrets, simhash
from quadrille.llm.bpe import read_ranks

SF = "/root/testdata/sf0.001"


def plain_clean(docs, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = set()
    for item in items:
        w = words(item)
        n = min(10, len(w))
        wins |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in wins}
    bad = lambda w: any(tuple(w[i : i + n]) in wins for n in sizes for i in range(len(w) - n + 1))
    return {i: t for i, t in docs.items() if not bad(words(t))}


def plain_masked(text):
    found = sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least)
    out, at = "", 0
    for a, b in found:
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return text if not found else out + text[at:]


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    as_dict = lambda df: {r.doc_id: r.text for r in df.collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert 4 <= len(stages) <= 5

    good = stages[0](spark, docs, SF).persist()
    verdict = {r.doc_id: r.predicted for r in quality.quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert good.columns == docs.columns and as_dict(good) == {i: t for i, t in as_dict(docs).items() if verdict[i]}

    single = stages[1](spark, good, SF).persist()
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in as_dict(good).items()}
    root = {i: i for i in prints}
    for _ in prints:
        before = dict(root)
        for i in prints:
            root[i] = min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3)
        if root == before:
            break
    assert single.columns == docs.columns and as_dict(single) == {i: t for i, t in as_dict(good).items() if root[i] == i}

    clean = stages[2](spark, single, SF).persist()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert clean.columns == docs.columns and as_dict(clean) == plain_clean(as_dict(single), items)

    masked = stages[3](spark, clean, SF).persist()
    assert masked.columns == docs.columns and as_dict(masked) == {i: plain_masked(t) for i, t in as_dict(clean).items()}

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {i: library.encode_ordinary(t or "") for i, t in as_dict(masked).items()}
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in stages[4](spark, masked, SF).collect()} == want
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_at_the_edges(spark):
    """Nulls in any column, empty and repeated rows, an empty table, through every stage after the classifier, and those that it keeps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first().text
    plain = "".join(f"some quite ordinary words number {k} of a longer text, " for k in range(12))
    rows = [
        (900001, None, None, None, None), (900002, "", "en", "s", 0), (None, "lonely " + plain, "en", "s", 5), (None, "lonely " + plain, "en", "s", 5),
        (900003, plain, "en", "s", 5), (900003, plain, "en", "s", 5), (900004, plain + "token = abcdefgh12", "en", None, 9), (900005, f"before {item} after", None, "s", 1),
    ]
    edge = spark.createDataFrame(rows, docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = stages["quality classifier"](spark, edge, SF)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    single = stages["SimHash near-dedup"](spark, edge, SF).collect()
    assert sorted(str(r.doc_id) for r in single if (r.text or "").startswith("lonely")) == ["None"]
    assert sum(r.text in (None, "") for r in single) == 1 and sum(r.doc_id == 900003 for r in single) == 1
    clean = stages["benchmark decontamination"](spark, edge, SF)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in rows[:-1])
    masked = {(r.doc_id, r.text, r.n_chars) for r in stages["secret scans"](spark, edge, SF).collect()}
    assert (900004, plain + "[secret]", len(plain) + 8) in masked and (900001, None, None) in masked and len(masked) == 6
    tokens = stages["byte-level BPE"](spark, edge, SF).collect()
    assert len(tokens) == len(rows) and {r.doc_id: r.n_tokens for r in tokens}[900001] == 0
