import random
from itertools import combinations

import numpy as np
import xxhash

from quadrille.llm.simhash import DISTANCE, components, fingerprint, hex_of, keep_one, links, near_duplicates


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(values):
    """The least value that each one reaches."""
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(values), 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= DISTANCE:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprint():
    rng = random.Random(1)
    texts = ["", " \n", "One", "one two", "a b c", "A  B\tc\x0bd e", "é\xa0È ñ ​ x y"] + [" ".join(rng.choice("abcdefg") * rng.randint(1, 9) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for text in texts:
        assert fingerprint(text.encode()) == plain_fingerprint(text)


def planted(rng, groups, size):
    """Fingerprints around centres, some of them many steps away."""
    found = set()
    for _ in range(groups):
        x = rng.getrandbits(64)
        for _ in range(size):
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                x ^= 1 << b
            found.add(x if x < 1 << 63 else x - (1 << 64))
    return found


def check_links(spark, values, long_list):
    got = {v: v for v in values} | {r.node: r.root for r in components(links(spark.createDataFrame([(v,) for v in values], "fp long"), long_list)).collect()}
    assert got == brute(values)


def test_links_and_components(spark):
    rng = random.Random(2)
    check_links(spark, planted(rng, 60, 8), 4096)


def test_long_lists_are_dealt_out(spark):
    rng = random.Random(3)
    # One crowd with equal bytes at most positions, so that lists of any kind of key are long.
    base = rng.getrandbits(63)
    crowd = {base ^ (rng.getrandbits(10) << rng.choice([0, 8, 40])) for _ in range(300)}
    check_links(spark, crowd | planted(rng, 10, 5), 16)


def test_rows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text, 0), (3, text + " x", 0), (9, None, 0), (8, "", 0), (7, "quite another", 0), (None, text, 0), (5, text, 0), (12, "ALONE here with words", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = near_duplicates(docs).select("doc_id", hex_of(__import__("pyspark").sql.functions.col("fp")).alias("h"), "component_id").collect()
    values = [plain_fingerprint(t) for _, t, _ in rows]
    roots = brute(set(values))
    least = {}
    for (i, _, _), v in zip(rows, values):
        if i is not None:
            least[roots[v]] = min(i, least.get(roots[v], i))
    want = [(i, f"{v:016x}", least[roots[v]]) for (i, _, _), v in zip(rows, values)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert near_duplicates(docs.limit(0)).count() == 0
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None"] + [str(i) for i in set(least.values())])


def test_rows_of_one_id_and_of_none(spark):
    text, other, third = (" ".join(f"{c}{i}" for i in range(400)) for c in "abc")
    rows = [(1, text), (1, other), (2, other + " x"), (1, text), (None, third), (None, third + " x"), (None, third), (None, "alone"), (4, text + " x"), (5, None), (5, "")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, (r.text or "")[:2]) for r in kept), key=str) == sorted([(1, "a0"), (1, "b0"), (None, "c0"), (None, "al"), (5, "")], key=str)
