"""Benchmark decontamination by a positional inverted index of the training documents.

The index is sharded by documents: each segment holds some megabytes of text as sorted terms, each
with the ascending positions at which it stands. Segments are written to the shared folder, a row
each, so a lost executor costs a reread of some of them. A search takes the benchmark's windows to
every segment, block by block. It looks up the terms of each window, passes over windows of which a term is missing,
and intersects the position lists of the rest, each shifted by the term's place in the window,
starting from the rarest term. Nothing is shuffled: a document's postings are in one segment.

Terms are 64-bit hashes of words, in the order of which a segment also has the words: a benchmark's word is looked up by its hash and
held against the word itself. Positions count words over a segment with one place left free
between documents, so that no phrase reaches over an end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import hashes, rows_of, runs, slices, stored, text_bytes

WINDOW = 10
#: Text in a segment, unless one document has more.
SEGMENT_BYTES = 512 << 10
#: Benchmark text in a block. One block is broadcast at a time, and each is taken to all segments.
BLOCK_BYTES = 8 << 20

#: Bytes of words, in lower case: ASCII digits and letters and all bytes of other characters; 0 elsewhere.
_WORD = np.zeros(256, np.uint8)
_WORD[0x30:0x3A] = np.arange(0x30, 0x3A)
_WORD[0x41:0x5B] = np.arange(0x61, 0x7B)
_WORD[0x61:0x7B] = np.arange(0x61, 0x7B)
_WORD[0x80:] = np.arange(0x80, 0x100)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes after A-Z are lower-cased, and where the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ start and end in them."""
    lower = _WORD[data]
    return lower, *runs(lower != 0, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and its row."""
    lower, starts, ends = cut(data, offsets)
    return hashes(lower, starts, ends), rows_of(starts, offsets)


def spelt(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the given words, one after the other."""
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    return lower[np.arange(int(lengths.sum())) + np.repeat(starts - firsts, lengths)]


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The segments of docs(doc_id, text), not yet written: segment (a number of its own, drawn at random),
    doc_ids (of the segment's rows, in order), n_words (of each row), words (of the terms, joined) and word_ends, terms (sorted 64-bit hashes), ends (of each term's positions) and positions
    (32-bit), the last three as little-endian arrays. Null texts have no words; a null doc_id stays."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", segment_bytes):
            data, offsets = text_bytes(batch.column(1))
            lower, starts, stops = cut(data, offsets)
            term, row = hashes(lower, starts, stops), rows_of(starts, offsets)
            at = np.arange(len(term)) + row  # one place free between rows
            order = np.argsort(term, kind="stable")
            unique, first = np.unique(term[order], return_index=True)
            ends = np.append(first[1:], len(term)) if len(term) else first
            some = order[first]
            columns = {
                "segment": pa.array([uuid.uuid4().hex]),
                "doc_ids": pa.array([batch.column(0).to_pylist()], pa.list_(batch.column(0).type)),
                "n_words": pa.array([np.bincount(row, minlength=batch.num_rows)], pa.list_(pa.int64())),
                "words": pa.array([spelt(lower, starts[some], stops[some]).tobytes()]),
                "word_ends": pa.array([np.cumsum(stops[some] - starts[some]).astype("<i4").tobytes()]),
                "terms": pa.array([unique.astype("<u8").tobytes()]),
                "ends": pa.array([ends.astype("<i4").tobytes()]),
                "positions": pa.array([at[order].astype("<i4").tobytes()]),
            }
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"segment string, doc_ids array<{kind}>, n_words array<long>, words binary, word_ends binary, terms binary, ends binary, positions binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass
class Windows:
    """The windows of a block of items: places in words and their terms, -1 beyond a short window; the item of each."""

    words: list[bytes]
    terms: np.ndarray
    places: np.ndarray
    items: np.ndarray
    names: list[str]


def vocabulary(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The different words of the texts and their terms; the number and the row of each word that stands there."""
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    lower, starts, ends = cut(data, offsets)
    known: dict[bytes, int] = {}
    raw = lower.tobytes()
    ids = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
    first = np.unique(ids, return_index=True)[1]
    return list(known), hashes(lower, starts, ends)[first], ids, rows_of(starts, offsets)


def windows(rows: list[tuple[object, str | None]], width: int = WINDOW) -> Windows:
    """All windows of width consecutive words of each item; an item of fewer words, but not none, is
    one window. Items of the same id count as one."""
    own_words, term, ids, row = vocabulary([t for _, t in rows])
    names = sorted({str(i) for i, _ in rows})
    number = {name: k for k, name in enumerate(names)}
    places, items = [], []
    bounds = np.searchsorted(row, np.arange(len(rows) + 1))
    for i, (name, _) in enumerate(rows):
        own = ids[bounds[i] : bounds[i + 1]]
        if not len(own):
            continue
        if len(own) < width:
            views = np.pad(own, (0, width - len(own)), constant_values=-1)[None]
        else:
            views = np.lib.stride_tricks.sliding_window_view(own, width)
        places.append(views)
        items.append(np.full(len(views), number[str(name)]))
    if not places:
        return Windows(own_words, term, np.zeros((0, width), np.int64), np.zeros(0, np.int64), names)
    both = np.unique(np.column_stack([np.concatenate(items), np.concatenate(places)]), axis=0)
    return Windows(own_words, term, both[:, 1:], both[:, 0], names)


class Segment:
    """The postings of one row of the index."""

    def __init__(self, n_words, words: bytes, word_ends: bytes, terms: bytes, ends: bytes, positions: bytes):
        self.words, self.word_ends = words, np.frombuffer(word_ends, "<i4")
        self.terms = np.frombuffer(terms, "<u8")
        self.ends = np.frombuffer(ends, "<i4").astype(np.int64)
        self.positions = np.frombuffer(positions, "<i4")
        self.n_words = np.asarray(n_words, np.int64)
        self.bases = np.concatenate([[0], np.cumsum(self.n_words + 1)])[:-1] if len(self.n_words) else np.zeros(0, np.int64)

    def lookup(self, terms: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's positions begin and end here; nowhere if another word has its hash."""
        begin, end = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        if not len(self.terms):
            return begin, end
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        for i in np.flatnonzero(self.terms[k] == terms).tolist():
            j = int(k[i])
            if self.words[self.word_ends[j - 1] if j else 0 : self.word_ends[j]] == words[i]:
                begin[i], end[i] = self.ends[j - 1] if j else 0, self.ends[j]
        return begin, end

    def phrases(self, w: Windows) -> Iterator[tuple[int, int, np.ndarray]]:
        """The number, length and ascending starting positions of each window that stands here."""
        begin, end = self.lookup(w.terms, w.words)
        count = np.append(end - begin, np.iinfo(np.int64).max)  # the last is for places beyond a short window
        sizes = count[w.places]
        for k in np.flatnonzero((sizes > 0).all(1)):
            length = int((w.places[k] >= 0).sum())
            order = np.argsort(sizes[k, :length], kind="stable")
            found = None
            for o in order:
                t = w.places[k, o]
                at = self.positions[begin[t] : end[t]]
                if found is None:
                    found = at - o
                else:
                    i = np.minimum(np.searchsorted(at, found + o), len(at) - 1)
                    found = found[at[i] == found + o]
                if not len(found):
                    break
            if len(found):
                yield int(k), length, found

    def near(self, terms: np.ndarray, words: list[bytes], span: int) -> np.ndarray:
        """Rows that have all of the (different) words, in any order, within span consecutive words: every occurrence of
        the rarest term is held against the next occurrences of the others on either side."""
        begin, end = self.lookup(terms, words)
        if not len(terms) or (begin == end).any():
            return np.zeros(0, np.int64)
        lists = sorted((self.positions[b:e].astype(np.int64) for b, e in zip(begin, end)), key=len)
        # A span may begin at any occurrence of any term; it holds all if the next of each is in reach.
        starts = np.concatenate([lists[0], *[x[self._reach(x, lists[0], span)] for x in lists[1:]]])
        rows = rows_of(starts, np.append(self.bases, np.iinfo(np.int64).max))
        last = np.minimum(starts + span, self.bases[rows] + self.n_words[rows])
        good = np.ones(len(starts), bool)
        for x in lists:
            i = np.searchsorted(x, starts)
            good &= (i < len(x)) & (x[np.minimum(i, len(x) - 1)] < last)
        return np.unique(rows[good])

    @staticmethod
    def _reach(x: np.ndarray, rare: np.ndarray, span: int) -> np.ndarray:
        i = np.searchsorted(rare, x)
        return (i < len(rare)) & (rare[np.minimum(i, len(rare) - 1)] - x < span)


def _named(items: DataFrame) -> DataFrame:
    """item_id (string), text of the items that have a text."""
    return items.select("item_id", "text").where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of about block_bytes of text, one block on the driver at a time."""
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [tuple(r) for r in block.collect()]


def _passes(index: DataFrame, values: Iterator, run, schema: str) -> DataFrame:
    """run(segment's row, value) over the whole index for each of the values, which are broadcast one
    after the other; what it finds is written before the next one is."""
    spark, found = index.sparkSession, None
    for value in values:
        shared = spark.sparkContext.broadcast(value)

        def one(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    yield from run(batch.slice(r, 1).to_pylist()[0], shared.value)

        part = stored(index.select("segment", "n_words", "words", "word_ends", "terms", "ends", "positions").mapInArrow(one, schema), "hits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def search(index: DataFrame, items: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted strings), items_sha256, contaminated, spans
    (first and one past the last word of each hit run) for each row that was indexed. index is a written
    one, since it is read several times.

    items(item_id, text); null texts have no words and a null item_id is named 'null'. An item's windows
    are searched as exact phrases; a word inside any occurrence is hit. There is a pass over the index for
    each block of items; hits, a row for each document that has any and block, are put together after."""
    spans_type = "array<struct<start:bigint,end:bigint>>"

    def run(row: dict, w: Windows) -> Iterator[pa.RecordBatch]:
        segment = Segment(*(row[c] for c in ("n_words", "words", "word_ends", "terms", "ends", "positions")))
        if not len(segment.n_words):
            return
        edges = np.zeros(int(segment.n_words.sum()) + len(segment.n_words) + 1, np.int32)
        named: dict[int, set[str]] = {}
        for k, length, found in segment.phrases(w):
            np.add.at(edges, found, 1)
            np.add.at(edges, found + length, -1)
            for r in np.unique(np.searchsorted(segment.bases, found, side="right") - 1).tolist():
                named.setdefault(r, set()).add(w.names[w.items[k]])
        if not named:
            return
        bounds = np.append(segment.bases, len(edges) - 1)
        starts, stops = runs(np.cumsum(edges[:-1]) > 0, bounds)
        at = rows_of(starts, bounds)
        spans: dict[int, list[dict]] = {r: [] for r in named}
        for r, a, b in zip(at.tolist(), (starts - segment.bases[at]).tolist(), (stops - segment.bases[at]).tolist()):
            spans[r].append({"start": a, "end": b})
        yield pa.RecordBatch.from_pydict({
            "segment": pa.array([row["segment"]] * len(named)), "row": pa.array(list(named), pa.int64()), "items": pa.array([sorted(x) for x in named.values()], pa.list_(pa.string())),
            "spans": pa.array([spans[r] for r in named], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })

    values = (windows(b, width) for b in _blocks(_named(items), block_bytes))
    hits = _passes(index, values, run, f"segment string, row long, items array<string>, spans {spans_type}")
    met = hits.groupBy("segment", "row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Runs of different blocks may overlap or touch; in order, each either lengthens the last one or begins a new one.
        for batch in batches:
            merged = []
            for spans in batch.column(3).to_pylist():
                done: list[dict] = []
                for x in spans:
                    if done and x["start"] <= done[-1]["end"]:
                        done[-1]["end"] = max(done[-1]["end"], x["end"])
                    else:
                        done.append(x)
                merged.append(done)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(merged, batch.schema.field(3).type)], names=["segment", "row", "items", "spans"])

    met = met.mapInArrow(merge, f"segment string, row long, items array<string>, spans {spans_type}")
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("row", "r")).select("segment", F.col("row").cast("long").alias("row"), F.col("r.doc_ids").alias("doc_id"), F.col("r.n_words").alias("n_words"))
    out = rows.join(met, ["segment", "row"], "left")
    items_, spans_ = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("spans", F.array().cast(spans_type))
    n_hit = F.aggregate(spans_, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
        (F.size(spans_) > 0).alias("contaminated"), spans_.alias("spans"),
    )


def search_near(index: DataFrame, items: DataFrame, span: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id (string): documents that have all words of an item, in any order, within span
    consecutive words; one row for each indexed row and item. An item longer than span never matches."""
    def sets(block: list[tuple]) -> list[tuple[str, np.ndarray, list[bytes]]]:
        own, term, ids, row = vocabulary([t for _, t in block])
        numbers = [(i, np.unique(ids[row == i])) for i in np.unique(row)]
        return [(block[i][0], term[k], [own[j] for j in k.tolist()]) for i, k in numbers]

    def run(row: dict, wanted: list[tuple[str, np.ndarray, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        segment = Segment(*(row[c] for c in ("n_words", "words", "word_ends", "terms", "ends", "positions")))
        for name, terms, own in wanted:
            found = segment.near(terms, own, span)
            if len(found):
                yield pa.RecordBatch.from_pydict({"segment": pa.array([row["segment"]] * len(found)), "row": pa.array(found, pa.int64()), "item_id": pa.array([name] * len(found))})

    hits = _passes(index, (sets(b) for b in _blocks(_named(items), block_bytes)), run, "segment string, row long, item_id string")
    rows = index.select("segment", F.posexplode("doc_ids").alias("row", "doc_id")).select("segment", F.col("row").cast("long").alias("row"), "doc_id")
    return rows.join(hits, ["segment", "row"]).select("doc_id", "item_id").distinct()


def written_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """build_index, written to the shared folder. Row groups are small, so that few segments are in
    memory at once."""
    return stored(build_index(docs, segment_bytes), "postings", **{"parquet.block.size": 16 << 20, "compression": "zstd"})


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """search() over all of docs; see there for the columns and build_index() for nulls."""
    return search(written_index(docs), items, width)


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs without those of which a row is contaminated; columns stay as they are. Rows of one doc_id
    are one document; those without a doc_id are one for each text."""
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.sha2(F.coalesce("text", F.lit("")), 256))))
    found = contamination(keyed.select(F.col("__key").alias("doc_id"), "text"), items, width)
    gone = stored(found.where("contaminated").select(F.col("doc_id").alias("__key")).distinct(), "contaminated")
    return keyed.join(gone, "__key", "left_anti").select(*docs.columns)
