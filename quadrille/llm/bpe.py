"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 machine decodes.

Every prefix of a piece has exactly one encoding by the merges, so the last token of that encoding is
a function of the prefix. The machine runs over all places from which a vocabulary entry may still
grow at once, as one state; an arc gives the last token of what has been read. A place is dropped as
soon as no entry that may stand there is left. Once the end of what has been read is the only place,
all tokens up to it are certain and are written; where several places stay on and on, those that all of
them have in common are, so each token is written after a lookahead bounded by the longest entry.
States and arcs are made when first asked for and dropped all together beyond a bound, as lazy automata
do; what is dropped is made again, so results don't depend on the bound.

Two tokens may stand side by side exactly if the merges turn their joined bytes back into the two.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quadrille.llm.common import slices

#: Unicode white space as the pattern's \s has it. Fixed value.
WHITE = "\t-\r \x85\xa0  -     　"
#: The pattern that the cuts below are made for; texts are cut by any other pattern itself. Fixed value.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Cuts of a text at which a match of that pattern always begins: what stands between white space, with one space before it.
CHUNKS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
CHUNK_CUT = CHUNKS.findall
MAX_STATES = 150_000
#: Encoded strings that are kept at hand in each of two generations, and the longest of them.
MAX_CHUNKS = 250_000
LONGEST_CHUNK = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token, a space, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(ranks: dict[bytes, int], piece: bytes, stop: int = 1) -> list[bytes]:
    """The encoding by the definition: join the neighbours of the lowest rank, leftmost first; no
    further than to so many parts."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > stop:
        best = min(((ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in ranks), default=None)
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


class Transducer:
    """encode(piece) gives the ranks of a piece's tokens; stream(bytes) the same, as they become certain.

    A state is the set of places from which an entry may still grow: for each the node of the
    vocabulary's trie that the bytes since then lead to, and which entries may stand there, either as
    the last token before the place or, where few are left, as these entries themselves."""

    #: Entries below a node up to which those that may stand at a place are listed.
    FEW = 16
    #: Bytes after which the places are asked what they agree on, if the end is never the only one.
    AGREE = 16

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.max_states = max_states
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack {len(missing)} single bytes")
        self.entries = {rank: t for t, rank in ranks.items()}
        self.lengths = {rank: len(t) for t, rank in ranks.items()}
        # The trie: a node's entries are a range of all entries in order, its own (if any) the first.
        ordered = sorted(ranks)
        self.order = [ranks[t] for t in ordered]
        self.child: dict[int, int] = {}
        self.token, self.low, self.high = [-1], [0], [len(ordered)]
        for i, entry in enumerate(ordered):
            node = 0
            for byte in entry:
                to = self.child.get(node << 8 | byte)
                if to is None:
                    to = self.child[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.low.append(i)
                    self.high.append(i)
                node = to
                self.high[node] = i + 1
            self.token[node] = ranks[entry]
        self._own: dict[int, list[int]] = {}
        self._pairs: dict[int, bool] = {}
        self._lefts: dict[int, list] = {}
        self._rights: dict[int, list] = {}
        self._clear()

    def _clear(self) -> None:
        # A place: a node, and the last token before (-1: none) or, from -2 down, the number of a list of entries.
        self.states: list[tuple[tuple[int, int], ...]] = [((0, -1),)]
        self.numbers = {self.states[0]: 0}
        self.arcs: list[dict[int, tuple[int, int, bool]]] = [{}]
        self.behind: list[tuple[int, ...]] = [(0,)]  # how many bytes stand behind each place
        self.lists: list[tuple[int, ...]] = []
        self.list_numbers: dict[tuple[int, ...], int] = {}
        self.moves: dict[int, tuple[bool, int | None]] = {}
        self.kinds: dict[tuple[bool, int | None], tuple[bool, int | None]] = {}  # equal moves are one object

    def _parts(self, rank: int) -> list[int]:
        """The tokens that the last merge joins to make this one, worked out once; a byte is its own, and a token that the merges
        don't make out of its bytes has three or more."""
        known = self._own.get(rank)
        if known is None:
            known = self._own[rank] = [self.ranks[p] for p in merge(self.ranks, self.entries[rank], 2)]
        return known

    def _reachable(self, rank: int) -> bool:
        """Whether the merges make the token out of its own bytes."""
        return len(self._parts(rank)) < 3

    def _spine(self, rank: int, left: bool) -> list[tuple[bytes, float, float]]:
        """The parts that stand at the token's left or right edge while the merges make it: each with
        the rank that makes it and the rank that uses it up."""
        cache = self._lefts if left else self._rights
        known = cache.get(rank)
        if known is None:
            known = cache[rank] = []
            until: float = math.inf
            while True:
                single = self.lengths[rank] == 1
                known.append((self.entries[rank], -1 if single else rank, until))
                if single:
                    break
                until, rank = rank, self._parts(rank)[0 if left else -1]
        return known

    def _beside(self, left: int, right: int) -> bool:
        """Whether no merge joins parts of both: for such parts to be joined they must stand there at
        the same time, and the rank that joins them must come before those that use them up; of equal
        ranks the one further left comes first. Left of the first token is -1."""
        if left < 0:
            return True
        known = self._pairs.get(left << 32 | right)
        if known is None:
            if len(self._pairs) > 2 * self.max_states:
                self._pairs.clear()
            known, get = True, self.ranks.get
            for x, made_x, used_x in self._spine(left, False):
                for y, made_y, used_y in self._spine(right, True):
                    if made_x < used_y and made_y < used_x:
                        rank = get(x + y)
                        if rank is not None and rank < used_x and rank <= used_y:
                            known = False
            self._pairs[left << 32 | right] = known
        return known

    def _move(self, node: int, before: int) -> tuple[bool, int | None]:
        """Whether the node's own entry may stand at a place, and what may stand there of those below
        the node (as in a state); None if nothing may."""
        own, listed = self.token[node], self.lists[-2 - before] if before < -1 else None
        fits = (lambda r: r in listed) if listed is not None else (lambda r: self._reachable(r) and self._beside(before, r))
        stands = own >= 0 and fits(own)
        below = self.order[self.low[node] + (own >= 0) : self.high[node]]
        if listed is None and len(below) > self.FEW:
            return stands, before
        left = tuple([r for r in below if fits(r)])
        if not left:
            return stands, None
        number = self.list_numbers.get(left)
        if number is None:
            number = self.list_numbers[left] = -2 - len(self.lists)
            self.lists.append(left)
        return stands, number

    def _arc(self, number: int, byte: int) -> tuple[int, int, bool]:
        child, moves, last, kept, behind = self.child.get, self.moves, None, [], []
        for (node, before), back in zip(self.states[number], self.behind[number]):  # the longest token first
            to = child(node << 8 | byte)
            if to is None:
                continue
            move = moves.get(to << 32 | before + (1 << 31))
            if move is None:
                move = self._move(to, before)
                move = moves[to << 32 | before + (1 << 31)] = self.kinds.setdefault(move, move)
            if move[0] and last is None:
                last = self.token[to]
            if move[1] is not None:
                kept.append((to, move[1]))
                behind.append(back + 1)
        assert last is not None
        kept.append((0, last))
        behind.append(0)
        state = tuple(kept)
        to = self.numbers.get(state)
        if to is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.arcs.append({})
            self.behind.append(tuple(behind))
        arc = self.arcs[number][byte] = (to, last, len(kept) == 1)
        return arc

    def stream(self, piece: Iterable[int]) -> Iterator[int]:
        """The ranks as they become certain, while the bytes of a piece arrive."""
        state, arcs = 0, self.arcs
        lasts: list[int] = []  # the last token at each place that isn't written yet
        for byte in piece:
            state, last, alone = arcs[state].get(byte) or self._arc(state, byte)
            lasts.append(last)
            if alone:
                yield from self._chain(lasts, len(lasts))
                lasts.clear()
            elif not len(lasts) % self.AGREE:
                chains = [self._chain(lasts, len(lasts) - back) for back in self.behind[state]]
                shared = 0
                while all(len(c) > shared for c in chains) and len({c[shared] for c in chains}) == 1:
                    shared += 1
                yield from chains[0][:shared]
                del lasts[: sum(self.lengths[t] for t in chains[0][:shared])]
        yield from self._chain(lasts, len(lasts))

    def _chain(self, lasts: list[int], at: int) -> list[int]:
        if at == 1:
            return lasts[:1]
        out = []
        while at > 0:
            out.append(lasts[at - 1])
            at -= self.lengths[lasts[at - 1]]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        if len(self.states) > self.max_states:
            self._clear()
        state, arcs, out = 0, self.arcs, []
        lasts: list[int] = []
        for byte in piece:  # as in stream(), but what is certain is written without asking for agreement
            state, last, alone = arcs[state].get(byte) or self._arc(state, byte)
            lasts.append(last)
            if alone:
                if len(lasts) == 1:
                    out.append(last)
                else:
                    out += self._chain(lasts, len(lasts))
                lasts.clear()
        return out + self._chain(lasts, len(lasts)) if lasts else out


def as_bytes(ranks: list[int]) -> bytes:
    return array("I", ranks).tobytes() if sys.byteorder == "little" else np.array(ranks, "<u4").tobytes()


class Encoder:
    """Whole texts: each match of the pattern separately, without special tokens. Strings that were
    encoded before are looked up in two generations: what the older one has moves to the newer, and
    what is left in the older is forgotten when the newer is full."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_chunks: int = MAX_CHUNKS):
        self.transducer = Transducer(ranks)
        # \s is spelt out, so that both libraries agree on what white space is.
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.cut = CHUNK_CUT if pattern == CUT_PATTERN else self._matches
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.max_chunks = max_chunks

    def _matches(self, text: str) -> list[str]:
        return self.pieces.findall(text) if not self.pieces.groups else [m.group() for m in self.pieces.finditer(text)]

    def _keep(self, text: str, ids: bytes) -> bytes:
        if len(text) <= LONGEST_CHUNK:
            if len(self.known) >= self.max_chunks:
                self.known, self.older = {}, self.known
            self.known[text] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        known = self.older.get(chunk)
        if known is not None:
            return self._keep(chunk, known)
        word = chunk[1:] if chunk[0] == " " else chunk
        # ASCII letters, a space before them or not, are one match; so is any cut that the pattern itself made.
        pieces = [chunk] if word.isascii() and word.isalpha() or self.cut is not CHUNK_CUT else self._matches(chunk)
        if len(pieces) == 1:
            return self._keep(chunk, as_bytes(self.transducer.encode(chunk.encode())))
        ids = []
        for piece in pieces:
            ids.append(self.known.get(piece) or self.older.get(piece) or self._keep(piece, as_bytes(self.transducer.encode(piece.encode()))))
        return self._keep(chunk, b"".join(ids))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        chunks = self.cut(text)
        found = list(map(self.known.get, chunks))
        at = -1
        while True:
            try:
                at = found.index(None, at + 1)  # the next that isn't at hand
            except ValueError:
                return b"".join(found)
            found[at] = self._chunk(chunks[at])


#: States of the UTF-8 machine: (bytes still missing, least and greatest next byte). Fixed values.
START = (0, 0x00, 0x7F)
LEADS = [(0xC2, 0xDF, (1, 0x80, 0xBF)), (0xE0, 0xE0, (2, 0xA0, 0xBF)), (0xE1, 0xEC, (2, 0x80, 0xBF)), (0xED, 0xED, (2, 0x80, 0x9F)), (0xEE, 0xEF, (2, 0x80, 0xBF)), (0xF0, 0xF0, (3, 0x90, 0xBF)), (0xF1, 0xF3, (3, 0x80, 0xBF)), (0xF4, 0xF4, (3, 0x80, 0x8F))]


class Utf8Stream:
    """Bytes in, text out, at any cut of the bytes. What can't be UTF-8 becomes U+FFFD, one for each
    longest part that could have begun a character."""

    def __init__(self) -> None:
        self.state, self.held = START, b""

    def step(self, byte: int) -> str:
        missing, low, high = self.state
        if missing:
            if low <= byte <= high:
                self.held += bytes([byte])
                self.state = (missing - 1, 0x80, 0xBF) if missing > 1 else START
                if missing > 1:
                    return ""
                text, self.held = self.held.decode(), b""
                return text
            self.state, self.held = START, b""
            return "�" + self.step(byte)
        if byte <= 0x7F:
            return chr(byte)
        for first, last, state in LEADS:
            if first <= byte <= last:
                self.state, self.held = state, bytes([byte])
                return ""
        return "�"

    def feed(self, data: bytes) -> str:
        out, at = [], 0
        while at < len(data):
            if self.state is START:
                try:
                    out.append(data[at:].decode() if at else data.decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(data[at : at + e.start].decode())
                    at += e.start
            out.append(self.step(data[at]))
            at += 1
        return "".join(out)

    def close(self) -> str:
        out = "�" if self.held else ""
        self.state, self.held = START, b""
        return out


#: Ids whose bytes the UTF-8 machine is fed at a time.
DECODED_AT_ONCE = 4096


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text as it becomes certain, while the ids arrive; an id that the ranks lack raises KeyError."""
        utf8, ids = Utf8Stream(), iter(ids)
        while block := list(islice(ids, DECODED_AT_ONCE)):
            try:
                data = b"".join([self.tokens[i] for i in block])
            except (IndexError, TypeError):
                raise KeyError("an id that the ranks lack") from None
            if text := utf8.feed(data):
                yield text
        if text := utf8.close():
            yield text

    def decode(self, ids: bytes) -> str:
        """The text of ids in little-endian unsigned 32-bit integers, through the same machine."""
        return "".join(self.stream(np.frombuffer(ids, "<u4").tolist()))


_WORKERS: dict[int, tuple] = {}


def _codec(shared) -> tuple[Encoder, Decoder]:
    """One for each worker process and vocabulary."""
    ranks, pattern = shared.value
    key = id(shared.value)
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = (Encoder(ranks, pattern), Decoder(ranks), shared.value)
    return _WORKERS[key][:2]


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit; only if asked for), ids_sha256,
    decoded_sha256 for each row of docs(doc_id, text); other columns are not looked at. A null or
    empty text has no tokens, a null doc_id stays null, repeated rows stay repeated. The ids are decoded
    by the UTF-8 machine, block by block.

    No shuffle: rows are encoded where they are read. The vocabulary, broadcast, has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _codec(shared)
        for batch in slices(batches, "text"):
            encoded = [encoder.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array([len(x) // 4 for x in encoded], pa.int64())}
            if ids:
                columns["ids"] = pa.array(encoded, pa.binary())
            columns["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string())
            columns["decoded_sha256"] = pa.array([hashlib.sha256(decoder.decode(x).encode()).hexdigest() for x in encoded], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, " + "ids binary, " * ids + "ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def detokenize(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, text for each row of tokens(doc_id, ids). Null ids have a null text; ids that aren't
    UTF-8 together have U+FFFD in its place."""
    shared = tokens.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value[0])
        for batch in batches:
            texts = [None if x is None else decoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")
