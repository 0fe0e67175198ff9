"""SimHash near-duplicates by an inverted index over the fingerprints' bytes, with count filtering.

Fingerprints of 8 bytes that differ in at most 3 bits differ in at most 3 bytes, so they share at
least 5 bytes at the same positions. The index lists fingerprints by the values at three positions.
The positions come from two halves of four: whatever 5 positions two fingerprints share, three of
them lie in one half, so 8 kinds of key (4 for each half) reach every such pair. Along a list the
shared positional bytes of each pair are tallied; pairs with at least 5 are verified by their bits.

Lists hold different fingerprints only; equal ones fall together before. A list that is long all the
same is dealt out again by two of its five other positions (10 keys; a pair needs two of them as
well). Members of a list of such a key share five bytes and differ in three, which are six half bytes;
near ones share three of these, so a list that is still long is dealt out by them (20 keys). That leaves
12 bits: no list can have more than 4,096 members then.

No list emits its pairs: the links found along a list are joined there at once, and each member
emits at most one link. Components over all lists come from rounds of joins and minima.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import attach, bucketed, slices, stored

WIDTH = 3
DISTANCE = 3
#: Shared positional bytes that fingerprints at DISTANCE or less have at least.
LEAST_SHARED = 8 - DISTANCE
#: Longest list that isn't dealt out again by further positions.
LONG_LIST = 4096
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def byte_mask(positions) -> int:
    """The bits of the given byte positions, as a signed 64-bit number."""
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The SimHash of one text: ASCII letters in lower case, words between ASCII white space, shingles
    of width words with repeats (fewer words: the whole sequence), XXH64 with seed 42; a bit is 1 if
    it is 1 in over half the hashes. A text without words has 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    counts, n, step = np.zeros(64, np.int64), len(starts), 1 << 16
    stops = ends[width - 1 :].tolist()
    for at in range(0, n, step):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + step], stops[at : at + step])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [fingerprint((t or "").encode(), width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(np.array(found, np.uint64).view(np.int64))})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


class Forest:
    """Joined members of an array; each has the least index that it is joined with."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def near(x: np.ndarray) -> np.ndarray:
    """Where differences have at least LEAST_SHARED bytes of zero and, verified, at most DISTANCE bits."""
    out = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= LEAST_SHARED
    at = np.flatnonzero(out)
    out[at] = np.bitwise_count(x[at]) <= DISTANCE
    return out


def link_lists(lists: np.ndarray, fps: np.ndarray, forest: Forest, members: np.ndarray | None = None) -> None:
    """Joins near fingerprints of the same list; equal numbers in lists stand side by side. All lists
    at once: each step compares members at one distance along the list. members: their numbers in the
    forest."""
    members = np.arange(len(fps)) if members is None else members
    at = np.arange(len(fps))
    for lag in range(1, len(fps)):
        at = at[: np.searchsorted(at, len(fps) - lag)]
        at = at[lists[at] == lists[at + lag]]
        if not at.size:
            return
        open_ = at[forest.root[members[at]] != forest.root[members[at + lag]]]
        linked = open_[near(fps[open_] ^ fps[open_ + lag])]
        forest.join(members[linked], members[linked + lag])


def link_by_halves(fps: np.ndarray, forest: Forest, base: int) -> None:
    """The same for one list whose members share five bytes, dealt out by the half bytes that near ones
    share: all but DISTANCE of those in which any differ."""
    differ = np.bitwise_or.reduce(fps ^ fps[0])
    halves = [h for h in range(16) if int(differ) >> (4 * h) & 0xF]
    for shared in combinations(halves, max(0, len(halves) - DISTANCE)):
        key = fps & np.uint64(sum(0xF << (4 * h) for h in shared))
        order = np.argsort(key, kind="stable")
        link_lists(key[order], fps[order], forest, base + order)


def links(fps: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """a, b: links between different fingerprints of fps(fp) that differ in at most DISTANCE bits,
    enough of them that every such pair is connected. fps has each fingerprint once."""
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(byte_mask(t))).alias("v")) for k, t in enumerate(TRIPLES)])
    listed = fps.select("fp", F.explode(kinds).alias("e")).select("fp", "e.k", "e.v")
    long_ = listed.groupBy("k", "v").count().where(F.col("count") > long_list).select("k", "v", F.lit(True).alias("long"))
    marked = listed.join(long_, ["k", "v"], "left")

    def subkeys() -> Column:
        rest = F.lit(None)
        for k, t in enumerate(TRIPLES):
            pairs = combinations([p for p in range(8) if p not in t], 2)
            keys = F.array(*[F.struct(F.lit(s).alias("s"), F.col("fp").bitwiseAND(F.lit(byte_mask(p))).alias("w")) for s, p in enumerate(pairs)])
            rest = F.when(F.col("k") == k, keys).otherwise(rest)
        whole = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).cast("long").alias("w")))
        return F.when(F.col("long"), rest).otherwise(whole)

    dealt = marked.select("fp", "k", "v", F.explode(subkeys()).alias("e")).select("fp", "k", "v", "e.s", "e.w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def search(columns: list[np.ndarray]) -> pa.RecordBatch:
            fp = columns[0].view(np.uint64)
            change = np.zeros(len(fp), bool)
            for c in columns[1:]:
                change[1:] |= c[1:] != c[:-1]
            number = np.cumsum(change)
            begins = np.flatnonzero(np.concatenate([[True], change[1:]]))
            sizes = np.diff(np.append(begins, len(fp)))
            forest = Forest(len(fp))
            for i in np.flatnonzero((sizes > long_list) & (columns[3][begins] >= 0)):
                span = slice(begins[i], begins[i] + sizes[i])
                link_by_halves(fp[span], forest, int(begins[i]))
                number[span] = len(fp) + np.arange(sizes[i])
            link_lists(number, fp, forest)
            at = np.flatnonzero(forest.root != np.arange(len(fp)))
            return pa.RecordBatch.from_pydict({"a": pa.array(columns[0][at]), "b": pa.array(columns[0][forest.root[at]])})

        key = None  # of the last list, which may go on in the next batch
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
            if not len(new[0]):
                continue
            last = tuple(int(c[-1]) for c in new[1:])
            other = np.zeros(len(new[0]), bool)
            for c, x in zip(new[1:], last):
                other |= c != x
            if not held or (key == last and not other.any()):
                before = 0
            else:
                before = sum(len(h[0]) for h in held)
            held.append(new)
            cut = before + (int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0)
            if cut and (other.any() or key != last):
                whole = [np.concatenate([h[i] for h in held]) for i in range(5)]
                held = [[c[cut:] for c in whole]]
                yield search([c[:cut] for c in whole])
            key = last
        if held:
            yield search([np.concatenate([h[i] for h in held]) for i in range(5)])

    keys = ["k", "v", "s", "w"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of edges(a, b) the least node that it reaches.

    Rounds of two steps, each a minimum over neighbours (pre-aggregated where the rows are) and a
    join: larger neighbours move to a node's least neighbour, then a node and its smaller neighbours
    do. Each round's edges are written to the shared folder; the driver sees their number only."""

    def signature(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    before = signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        moved = edges.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).distinct()
        least = moved.groupBy("a").agg(F.min("b").alias("m"))
        down = moved.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u"))
        edges = down.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(edges, "edges")
        now = signature(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp, component_id for each row of docs(doc_id, text); other columns are not looked at.

    component_id is the smallest doc_id reached over fingerprints that differ in at most 3 bits, the
    row's own included. Null and empty texts have fingerprint 0 and link like any other. A null doc_id
    stays null and is never the smallest unless its whole component has no other. Repeated rows stay."""
    found = bucketed(fingerprints(docs, width), "fingerprints")
    firsts = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    reach = components(links(firsts.select("fp")))
    rooted = firsts.join(reach, firsts.fp == reach.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # A root's component may hold a smaller doc_id than the root itself.
    best = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = rooted.join(best, "root").select("fp", "component_id")
    return attach(found, "fp", moved).select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with one row of each near-duplicate component: the least by doc_id, then by the hash of its
    text, then by the other columns. All columns stay as they are. Rows of one doc_id whose texts aren't
    near-duplicates are in components of their own and stay. Rows without a doc_id are held against each
    other only: a component keeps one of them beside the one that has an id."""
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.unhex(F.sha2(text, 256)).alias("text"))
    keyed = docs.withColumn("__key", key)
    # Equal keys have equal texts, so a component's smallest key stands in no other one.
    found = near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), width)
    state = stored(found.groupBy(F.col("doc_id").alias("__key"), "component_id").agg((F.count("*") > 1).alias("repeated")), "kept")
    nameless = state.where("__key.none")
    last = nameless.groupBy("component_id").agg(F.min("__key").alias("__key"))
    gone = state.where("NOT __key.none AND __key != component_id").select("__key").unionByName(nameless.select("__key").join(last, "__key", "left_anti"))
    # As many keys as there are copies, so never broadcast: the plan is the same at every size.
    kept = keyed.join(gone.hint("merge"), "__key", "left_anti")
    again = state.where("repeated").select("__key")
    if again.isEmpty():
        return kept.select(*docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct("text", F.struct(*rest) if rest else F.lit(0))
    one = kept.join(again, "__key", "left_semi").groupBy("__key").agg(F.min_by(F.struct(*docs.columns), row).alias("r")).select("r.*")
    return kept.join(again, "__key", "left_anti").select(*docs.columns).unionByName(one)
