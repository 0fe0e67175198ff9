import hashlib
import random

from quadrille.llm.substring import repeats


def brute(rows, window=13):
    split = lambda t: [w for w in (t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if w]
    last = 1 << 62
    least = {}
    for key, text in rows:
        w = split(text)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(last if key is None else key, least.get(k, last))
    out = []
    for key, text in rows:
        w = split(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (last if key is None else key):
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本", "W1", "x,"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [words(rng.randint(11, 70)) for _ in range(12)]
    out = []
    for i in rng.sample(range(1000), 80):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            parts += words(rng.randint(0, 30)) + p[a : len(p) - rng.randint(0, 5)]
        out.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    out += [(2000 + k, out[k][1]) for k in range(5)] + [(3000, None), (3001, ""), (3002, "the " * 300), (3003, "the " * 40), (3004, "a b c")]
    out += [(None, out[0][1]), (None, " ".join(passages[0] + words(20))), (out[3][0], out[3][1]), (4000, " ".join(words(30000) + passages[1]))]
    return out


def test_against_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, n_words int")
    assert sorted(map(tuple, repeats(docs).collect()), key=str) == brute(data)
    # One shard, many shards, anchors taken for very common ones: all the same.
    assert sorted(map(tuple, repeats(docs, parts=1).collect()), key=str) == brute(data)
    assert sorted(map(tuple, repeats(docs, parts=40, common=2).collect()), key=str) == brute(data)
    assert sorted(map(tuple, repeats(docs, window=4).collect()), key=str) == brute(data, 4)


def test_texts_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x a  b c\ny")], "doc_id long, text string")
    assert [r.kept for r in repeats(docs, window=3, texts=True).orderBy("doc_id").collect()] == ["a b c d e", "x y"]
    assert repeats(docs.limit(0)).count() == 0
