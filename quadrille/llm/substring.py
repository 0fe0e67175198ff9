"""Substring dedup by repeated-phrase automata.

A window is a row of consecutive words. Its anchor is the least hash among the short word sequences
inside it, so equal windows have equal anchors and neighbouring windows mostly share theirs.

1. Anchors that only one document has can't lie in a passage that recurs. Hashes of all documents'
   anchors meet by value, packed by the thousand, and each document learns which of its own recur.
2. The windows around these, as stretches of words, are dealt out to shards by anchor; a stretch that
   stands in many places of a task's documents is sent once, with its places.
3. Each shard confirms recurring windows, word by word: those that stand in two documents at least.
   They are compiled into Aho-Corasick automata of a bounded size, and every stretch is streamed through
   them. What the automata find tells where each window stands, and so the smallest document it stands
   in; an occurrence in any other document is a hit.
4. Hits go back to their documents, which are read again and lose the words.

Documents are sent compressed, by a hash of their text and doc_id. Numbers are packed in rows.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import hashes, mix, powers, rows_of, slices, text_bytes, whole_words

WINDOW = 13
#: Words in the sequences that anchors are chosen from.
GRAM = 5
#: Windows in an automaton, at most (a single anchor's windows stay together). The library looks through a
#: node's children one by one, and the root has one for each first word, so small automata are faster.
AUTOMATON = 1_000
#: Documents with an anchor from which on each of its windows is dealt out for itself.
COMMON = 20_000
#: Text whose anchors are packed together.
PACK_BYTES = 16 << 20
#: Input to a part, at most on average: parts are held in memory.
PART_BYTES = 64 << 20
#: Stands for a null doc_id: after all others.
LAST = np.iinfo(np.int64).max


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values."""
    count = max(0, len(values) - n + 1)
    out, power = np.zeros(count, np.uint64), powers(n + 1, np.uint64(0x9E3779B97F4A7C15))
    for k in range(n):
        out += values[k : k + count] * power[k]
    return mix(out)


def anchors(words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The anchor of each window of one document's word hashes."""
    gram = min(GRAM, window)
    grams = rolling(words, gram)
    count = max(0, len(words) - window + 1)
    out = grams[:count].copy()
    for k in range(1, window - gram + 1):
        np.minimum(out, grams[k : k + count], out=out)
    return out


def key_of(doc_id: int, text: bytes) -> bytes:
    """Rows of the same doc_id and text have the same key, and need the same answers."""
    return xxhash.xxh3_128_digest(doc_id.to_bytes(8, "little", signed=True) + text)


def _ids(column: pa.Array) -> list[int]:
    return [LAST if x is None else x for x in column.to_pylist()]


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(doc_id, text, word hashes) of each row."""
    data, offsets = text_bytes(batch.column(1))
    starts, ends = whole_words(data, offsets)
    values = hashes(data, starts, ends)
    bounds = np.searchsorted(rows_of(starts, offsets), np.arange(batch.num_rows + 1))
    for i, doc_id in enumerate(_ids(batch.column(0))):
        yield doc_id, data[offsets[i] : offsets[i + 1]].tobytes(), values[bounds[i] : bounds[i + 1]]


def _packed(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array(columns["part"], pa.int64()), "kind": pa.array(columns["kind"], pa.int32()), "body": pa.array(columns["body"], pa.binary())})


PACKED = "part long, kind int, body binary"


def _rows(parts: dict[int, object], kind: int) -> pa.RecordBatch:
    """One row for each part, its body packed."""
    pack = zstandard.ZstdCompressor(level=1)
    return _packed({"part": list(parts), "kind": [kind] * len(parts), "body": [pack.compress(pickle.dumps(body, 5)) for body in parts.values()]})


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()


def _unpack(body: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(body))


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    """A part to a partition, its rows in order of kind."""
    return df.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "kind")


def _grouped(df: DataFrame, parts: int, run: Callable) -> DataFrame:
    """run over the rows of df, those of a part together and in order of kind."""
    return _dealt(df, parts).mapInArrow(run, PACKED)


def parts_of(docs: DataFrame) -> int:
    """As many parts as shuffle partitions, and more where the input, by what the plan knows of its size, is larger."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = size < 1 << 60  # tables that aren't read from files have no size
    return max(least, -(-size // PART_BYTES)) if known else least


def _split(numbers: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts numbers of the same part together, and where each part begins."""
    part = (numbers % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def anchor_rows(docs: DataFrame, parts: int, window: int) -> DataFrame:
    """Each document's different anchors, packed by their values' part: keys (first 8 bytes), counts, anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in slices(batches, "text", PACK_BYTES):
            keys, rows, values = [], [], []
            for batch in slices(iter([large]), "text"):
                for doc_id, text, words in _documents(batch):
                    own = np.unique(anchors(words, window))
                    if len(own):
                        rows.append(np.full(len(own), len(keys), np.uint32))
                        values.append(own)
                        keys.append(int.from_bytes(key_of(doc_id, text)[:8], "little"))
            if not keys:
                continue
            row, value, key = np.concatenate(rows), np.concatenate(values), np.array(keys, np.uint64)
            order, at = _split(mix(value), parts)
            row, value = row[order], value[order]
            out = {}
            for p in range(parts):
                if at[p + 1] > at[p]:
                    here = row[at[p] : at[p + 1]]
                    new = np.flatnonzero(np.diff(here, prepend=-1) != 0)
                    out[p] = (key[here[new]], np.diff(np.append(new, len(here))).astype(np.uint32), value[at[p] : at[p + 1]])
            yield _rows(out, 0)

    return docs.mapInArrow(run, PACKED)


def recurring_rows(packed: DataFrame, parts: int, common: int) -> DataFrame:
    """For each document its anchors that another one has too, and whether very many do; packed by the
    key's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part = None

        def answer() -> pa.RecordBatch:
            key = np.concatenate([np.repeat(k, n) for k, n, _ in held])
            value = np.concatenate([v for *_, v in held])
            order = np.argsort(value, kind="stable")
            key, value = key[order], value[order]
            begins = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            least, most = np.minimum.reduceat(key, begins), np.maximum.reduceat(key, begins)
            sizes = np.diff(np.append(begins, len(value)))
            keep = np.repeat(least != most, sizes)
            many = np.repeat(sizes >= common, sizes)[keep]
            key, value = key[keep], value[keep]
            order, at = _split(key, parts)
            return _rows({p: (key[o], value[o], many[o]) for p in range(parts) if len(o := order[at[p] : at[p + 1]])}, 0)

        for new, _, body in _bodies(batches):
            if new != part and held:
                yield answer()
                held = []
            part = new
            held.append(_unpack(body))
        if held:
            yield answer()

    return _grouped(packed, parts, run)


def document_rows(docs: DataFrame, parts: int) -> DataFrame:
    """Documents by their key's part, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text"):
            columns: dict[str, list] = {"part": [], "kind": [], "body": []}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw, number = (text or "").encode(), LAST if key is None else key
                columns["part"].append(int.from_bytes(key_of(number, raw)[:8], "little") % parts)
                columns["kind"].append(1)
                columns["body"].append((b"\1" if key is None else b"\0") + number.to_bytes(8, "little", signed=True) + pack.compress(raw))
            yield _packed(columns)

    return docs.mapInArrow(run, PACKED)


def _document(body: bytes) -> tuple[bool, int, bytes]:
    return body[:1] == b"\1", int.from_bytes(body[1:9], "little", signed=True), zstandard.ZstdDecompressor().decompress(body[9:])


def stretch_rows(answers: DataFrame, docs: DataFrame, parts: int, window: int) -> DataFrame:
    """Stretches of words around recurring anchors, packed by the anchor's part in two rows: the different
    stretches as (anchor, bytes) with the least and the greatest document each is in (kind 0), and for each
    place its stretch, key, doc_id and first word (kind 1). A number that both have says which belong together."""

    def packed(out: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        mark = uuid.uuid4().hex
        stretches = {}
        for p, (contents, numbers, _, docs, _) in out.items():
            least, most = np.full(len(contents), LAST), np.full(len(contents), np.iinfo(np.int64).min)
            np.minimum.at(least, numbers, docs)
            np.maximum.at(most, numbers, docs)
            stretches[p] = (mark, list(contents), least, most)
        yield _rows(stretches, 0)
        yield _rows({p: (mark, *places) for p, (_, *places) in out.items()}, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known = None, ()
        out: dict[int, tuple] = {}
        size = 0
        for new, kind, body in _bodies(batches):
            if new != part:
                part, known = new, []
            if kind == 0:
                known.append(_unpack(body))
                continue
            if isinstance(known, list):
                # Sorted by key, then anchor: a document's own lie together.
                key, value, many = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (zip(*known) if known else ((), (), ())))
                order = np.lexsort((value, key))
                known = (key[order], value[order], many[order].astype(bool))
            _, doc_id, text = _document(body)
            key = key_of(doc_id, text)
            at = np.searchsorted(known[0], np.uint64(int.from_bytes(key[:8], "little")), side="left")
            to = np.searchsorted(known[0], np.uint64(int.from_bytes(key[:8], "little")), side="right")
            if at == to:
                continue
            own, many = known[1][at:to], known[2][at:to]
            words = text.split()
            data, offsets = text_bytes(pa.array([text], pa.binary()))
            values = hashes(data, *whole_words(data, offsets))
            anchor = anchors(values, window)
            k = np.minimum(np.searchsorted(own, anchor), len(own) - 1)
            good = own[k] == anchor
            route = np.where(many[k], rolling(values, window), anchor)  # a very common anchor's windows part
            change = np.ones(len(route) + 1, bool)
            change[1:-1] = (route[1:] != route[:-1]) | (good[1:] != good[:-1]) | many[k][1:]
            bounds = np.flatnonzero(change)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if not good[a]:
                    continue
                stretch = b" ".join(words[a : b + window - 1])
                r = int(route[a])
                shard = out.setdefault(r % parts, ({}, [], [], [], []))
                number = shard[0].setdefault((r, stretch), len(shard[0]))
                for column, x in zip(shard[1:], (number, key, doc_id, a)):
                    column.append(x)
                size += 40 + (len(stretch) if number == len(shard[0]) - 1 else 0)
            if size > PACK_BYTES:
                yield from packed(out)
                out, size = {}, 0
        yield from packed(out)

    return _grouped(answers.unionByName(document_rows(docs, parts)), parts, run)


class Automaton:
    """Windows of words, numbered, for one pass over any words."""

    def __init__(self, patterns: list[tuple[int, ...]]):
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for number, words in enumerate(patterns):
            self.machine.add_word(words, number)
        self.machine.make_automaton()

    def stream(self, words: tuple[int, ...], window: int) -> list[tuple[int, int]]:
        """(first word, window's number) of each window that stands here."""
        return [(end - window + 1, number) for end, number in self.machine.iter(words)]


def confirmed(stretches: list[tuple[tuple[int, ...], int, int]], window: int) -> list[tuple[int, ...]]:
    """The windows that stand in two documents at least: in one stretch that does, or in two of them
    that are of different documents. Where they stand isn't kept."""
    seen: dict[tuple[int, ...], int | None] = {}  # the one document that it was seen in; None once confirmed
    for words, least, most in stretches:
        for i in range(len(words) - window + 1):
            key = words[i : i + window]
            if least != most or seen.setdefault(key, least) != least:
                seen[key] = None
    return [key for key, one in seen.items() if one is None]


def hits(stretches: list[tuple[tuple[int, ...], int, int]], window: int) -> Iterator[list[tuple[int, int]]]:
    """For each stretch (its words' numbers; least and greatest document it stands in): the windows in
    it that recur, as (first word, smallest document)."""
    patterns = confirmed(stretches, window)
    if not patterns:
        yield from ([] for _ in stretches)
        return
    machine = Automaton(patterns)
    found = [machine.stream(words, window) for words, _, _ in stretches]
    smallest = [LAST] * len(patterns)
    for (_, least, _), places in zip(stretches, found):
        for _, number in places:
            if least < smallest[number]:
                smallest[number] = least
    for places in found:
        yield [(first, smallest[number]) for first, number in places]


#: Runs of words that are packed together.
RUNS_AT_ONCE = 200_000


def hit_rows(packed: DataFrame, parts: int, window: int) -> DataFrame:
    """For each document the runs of words to remove, packed by its key's part: keys, first words, lengths.

    A part's different stretches are held at once; then its places go by, row by row, so a stretch
    that stands in very many places is held once."""

    def looked_through(held: list[tuple]) -> tuple[dict[str, np.ndarray], dict[int, tuple[np.ndarray, np.ndarray]]]:
        """The number of each stretch of each row, and by number the windows in it that recur and their smallest documents."""
        numbers: dict[tuple[int, bytes], int] = {}
        which: dict[str, np.ndarray] = {}
        least_, most_ = [], []
        for mark, contents, least, most in held:
            which[mark] = np.array([numbers.setdefault(c, len(numbers)) for c in contents], np.int64)
            least_.append(least)
            most_.append(most)
        at = np.concatenate(list(which.values()))
        least, most = np.full(len(numbers), LAST), np.full(len(numbers), np.iinfo(np.int64).min)
        np.minimum.at(least, at, np.concatenate(least_))
        np.maximum.at(most, at, np.concatenate(most_))
        names = list(numbers)
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def search(group: list[int]) -> None:
            vocabulary: dict[bytes, int] = {}
            stretches = [(tuple([vocabulary.setdefault(w, len(vocabulary)) for w in names[s][1].split(b" ")]), int(least[s]), int(most[s])) for s in group]
            for s, places in zip(group, hits(stretches, window)):
                if places:
                    start, small = np.array(places, np.int64).T
                    found[s] = (start, small)

        group: list[int] = []
        size = 0
        for s in sorted(range(len(numbers)), key=names.__getitem__):
            if size > AUTOMATON and names[s][0] != names[group[-1]][0]:
                search(group)
                group, size = [], 0
            group.append(s)
            size += names[s][1].count(b" ") + 2 - window
        search(group)
        return which, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        known: tuple | None = None
        out: dict[int, tuple[list, list, list]] = {}
        part, size = None, 0
        for new, kind, body in _bodies(batches):
            if new != part:
                part, held, known = new, [], None
            if kind == 0:
                held.append(_unpack(body))
                continue
            if known is None:
                known, held = looked_through(held), []
            which, found = known
            mark, numbers, keys, docs, firsts = _unpack(body)
            own = which[mark][np.array(numbers, np.int64)].tolist()
            for s, key, doc, first in zip(own, keys, docs, firsts):
                if s not in found:
                    continue
                start, small = found[s]
                here = start[small < doc]
                if not len(here):
                    continue
                runs = np.flatnonzero(np.diff(here, prepend=here[0] - 2) != 1)
                ends = np.append(runs[1:], len(here)) - 1
                rows = out.setdefault(int.from_bytes(key[:8], "little") % parts, ([], [], []))
                rows[0].extend([key] * len(runs))
                rows[1].extend((here[runs] + first).tolist())
                rows[2].extend((here[ends] - here[runs] + window).tolist())
                size += len(runs)
            if size > RUNS_AT_ONCE:
                yield _rows(out, 0)
                out, size = {}, 0
        yield _rows(out, 0)

    return _grouped(packed, parts, run)


def repeats(docs: DataFrame, window: int = WINDOW, parts: int | None = None, common: int = COMMON, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with texts the kept words as text, for each row of
    docs(doc_id, text); other columns are not looked at. doc_id is an integer.

    Words are [^\\x20\\x09-\\x0D]+. A word goes if a window of words over it also starts in a document of
    a smaller doc_id; rows of one doc_id don't remove each other's words. A null doc_id comes after all
    others, and rows without one don't remove each other's words. Null and empty texts have no words."""
    parts = parts or parts_of(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    answers = recurring_rows(anchor_rows(docs, parts, window), parts, common)
    found = hit_rows(stretch_rows(answers, docs, parts, window), parts, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known = None, {}
        made: list[tuple] = []
        size = 0
        for new, kind, body in _bodies(batches):
            if new != part:
                part, known = new, {}
            if kind == 0:
                for key, first, length in zip(*_unpack(body)):
                    known.setdefault(key, []).append((first, length))
                continue
            unnamed, doc_id, text = _document(body)
            words = text.split()
            gone = np.zeros(len(words) + 1, np.int64)
            for first, length in known.get(key_of(doc_id, text), ()):
                gone[first] += 1
                gone[first + length] -= 1
            keep = np.cumsum(gone[:-1]) == 0
            kept = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
            made.append((None if unnamed else doc_id, len(words), len(words) - int(keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            size += len(kept)
            if size > PACK_BYTES // 8:
                yield result(made)
                made, size = [], 0
        yield result(made)

    def result(made: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*made)) or [[]] * 5
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
        return pa.RecordBatch.from_arrays(arrays[: 4 + texts], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + texts])

    rows = _dealt(found.unionByName(document_rows(docs, parts)), parts)
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
