"""Secret scans with a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is taken apart into a Boolean query of trigrams that every match must
contain: an alternation of sets of trigrams, or none at all. The index lists, for each trigram that a
query mentions, the documents that contain it (letters folded), by a hash of their id and text, so that
many rows of one id or without one are not one document; it is written to the shared folder. It has
the trigrams of the rules at hand only: other rules need an index of their own. Lists are intersected by
document: a document's trigrams meet as bits, and a rule has it as a candidate if all bits of one of its
sets are there. Rules without mandatory trigrams scan all documents. Candidates are joined to the
documents by that hash, by merge at every size, and verified by the rule's own expression over the
whole text. Two documents of one hash would be candidates together, which verification mends.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import stored

#: Strings that a part of an expression is spelt out to, at most; beyond, it counts as unknown.
MAX_STRINGS = 64
MAX_CLASS = 4
#: Characters in the blocks that a text is cut into, to take pieces out of it.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """kind names the spans; group (of pattern) must have at least least characters, else the match is
    dropped. Matches are leftmost and don't overlap."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The rules that any scan has, then those that this method adds. Fixed values.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosted", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + ADDED


def _fold(strings: set[str]) -> set[str]:
    """ASCII letters in lower case, as the index has them."""
    return {"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s) for s in strings}


def _exact(node) -> set[str] | None:
    """All strings that a parsed part stands for, or None if they are too many."""
    op, arg = node
    if op is rc.LITERAL:
        return {chr(arg)}
    if op is rc.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is rc.LITERAL:
                out.add(chr(value))
            elif kind is rc.RANGE and value[1] - value[0] < MAX_CLASS:
                out |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None
        out = _fold(out)
        return out if len(out) <= MAX_CLASS else None
    if op is rc.SUBPATTERN:
        return _exact_all(arg[-1])
    if op is rc.BRANCH:
        parts = [_exact_all(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        low, high, part = arg
        inner = _exact_all(part)
        if inner is None or high is rc.MAXREPEAT or len(inner) ** high > MAX_STRINGS:
            return None
        return {"".join(x) for k in range(low, high + 1) for x in product(inner, repeat=k)}
    return None


def _exact_all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _exact(node)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


Query = frozenset  # of alternatives, each a frozenset of trigrams; one empty alternative: anything


def _grams(strings: set[str]) -> frozenset:
    sets = frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in _fold(strings))
    return frozenset([frozenset()]) if frozenset() in sets else sets


def _both(a: frozenset, b: frozenset) -> frozenset:
    return frozenset(x | y for x in a for y in b) if len(a) * len(b) <= MAX_STRINGS else min(a, b, key=len)


def _query(nodes) -> frozenset:
    """What every match of the parts in a row contains."""
    out, run = frozenset([frozenset()]), {""}
    for node in nodes:
        op, arg = node
        more = _exact(node)
        if more is not None and len(run) * len(more) <= MAX_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        out = _both(out, _grams(run))
        run = {""}
        if more is not None:
            run = more
        elif op is rc.SUBPATTERN:
            out = _both(out, _query(arg[-1]))
        elif op is rc.BRANCH:
            parts = [_query(p) for p in arg[1]]
            out = _both(out, frozenset().union(*parts) if all(frozenset() not in p for p in parts) else frozenset([frozenset()]))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] > 0:
            out = _both(out, _query(arg[2]))
    return _both(out, _grams(run))


def trigram_query(pattern: str) -> frozenset:
    """The alternatives of which every match has one: sets of trigrams, all of them in its text with
    ASCII letters folded. An empty set among them: the rule has no mandatory trigrams."""
    query = _query(rp.parse(pattern))
    return frozenset(q for q in query if not any(other < q for other in query))


def trigrams(rules: Sequence[Rule]) -> list[str]:
    return sorted({g for r in rules for q in trigram_query(r.pattern) for g in q})


def key_of(docs: DataFrame) -> Column:
    """By which the index names a document; equal rows have the same."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def build_index(docs: DataFrame, grams: Sequence[str]) -> DataFrame:
    """trigram, key: the documents that contain each of the given trigrams, ASCII letters folded. A null
    text contains none."""
    low = F.lower(F.coalesce("text", F.lit("")))
    listed = [F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams] or [F.lit(None).cast("string")]
    found = docs.select(key_of(docs).alias("key"), low.alias("low")).select("key", F.explode(F.array_compact(F.array(*listed))).alias("trigram"))
    return found.select("trigram", "key")


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """key, rules (array of the kinds whose query the document satisfies), for rules with mandatory trigrams."""
    grams = trigrams(rules)
    bit = {g: (k // 62, k % 62) for k, g in enumerate(grams)}
    words = -(-len(grams) // 62) or 1
    masks = [F.coalesce(F.bit_or(F.coalesce(_choose({g: 1 << b for g, (w, b) in bit.items() if w == k}), F.lit(0).cast("long"))), F.lit(0).cast("long")).alias(f"m{k}") for k in range(words)]
    met = index.groupBy("key").agg(*masks)
    kinds = []
    for r in rules:
        query = trigram_query(r.pattern)
        if frozenset() in query:
            continue
        alternatives = F.lit(False)
        for q in sorted(query, key=sorted):
            every = F.lit(True)
            for k in range(words):
                need = sum(1 << b for g, (w, b) in bit.items() if w == k and g in q)
                if need:
                    every = every & (F.col(f"m{k}").bitwiseAND(F.lit(need).cast("long")) == F.lit(need).cast("long"))
            alternatives = alternatives | every
        kinds.append(F.when(alternatives, F.lit(r.kind)))
    held = F.array_compact(F.array(*kinds)) if kinds else F.array().cast("array<string>")
    return met.select("key", held.alias("rules")).where(F.size("rules") > 0)


def _choose(values: dict[str, int]) -> Column:
    out = F.lit(None).cast("long")
    for g, v in values.items():
        out = F.when(F.col("trigram") == g, F.lit(v).cast("long")).otherwise(out)
    return out


def _quick(rule: Rule) -> str:
    """An expression that finds a match in any text where the rule keeps one."""
    return rule.pattern[:-1] + "{%d,}" % rule.least if rule.group == 0 and rule.least > 1 and rule.pattern.endswith("]+") and rule.pattern.startswith("[") else rule.pattern


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being worked out once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Doublings after which a running total covers any array.
DOUBLINGS = 31


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What join makes of all values up to each place, in about n log n steps: at each, every place is
    joined with the one twice as far before it."""
    def doubled(step: int) -> Callable[[Column], Column]:
        return lambda a: F.when(F.size(a) <= step, a).otherwise(F.transform(a, lambda x, i: F.when(i >= step, join(F.get(a, i - step), x)).otherwise(x)))

    for k in range(DOUBLINGS):
        values = let(values, doubled(1 << k))
    return values


SPANS = "array<struct<start:bigint,end:bigint>>"


def spans_of(text: Column, rule: Rule) -> Column:
    """The rule's spans in a text, as an array of (start, end) in code points. What lies between matches
    is cut out by the same expression; a match ends at the running total of the lengths, so that a
    text with very many matches takes time about in proportion to them."""
    pattern = F.lit(_quick(rule))
    between = F.transform(F.split(text, _quick(rule), -1), lambda x: F.length(x).cast("long"))
    lengths = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x).cast("long"))
    kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x) >= rule.least)

    def placed(m: Column) -> Column:
        each = let(between, lambda p: F.transform(m, lambda x, i: F.get(p, i) + x))
        ends = running(each, lambda a, b: a + b)
        spans = let(ends, lambda e: F.transform(m, lambda x, i: F.struct((F.get(e, i) - x).alias("start"), F.get(e, i).alias("end"))))
        return let(kept, lambda k: F.filter(spans, lambda s, i: F.get(k, i))) if rule.least > 1 else spans

    return F.when(text.rlike(_quick(rule)), let(lengths, placed)).otherwise(F.array().cast(SPANS))


def _marked(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """docs and __rules: the kinds to verify in each row, besides those that scan fully."""
    index = stored(build_index(docs, trigrams(rules)), "trigrams")
    found = stored(candidates(index, rules), "candidates").select(F.col("key").alias("__key"), F.col("rules").alias("__rules"))
    return docs.withColumn("__key", key_of(docs)).join(found.hint("merge"), "__key", "left").drop("__key")


def _spans(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """docs with __s0, __s1, ...: each rule's spans."""
    text = F.coalesce("text", F.lit(""))
    found = _marked(docs, rules)
    out = []
    for k, r in enumerate(rules):
        spans = spans_of(text, r)
        if frozenset() not in trigram_query(r.pattern):
            spans = F.when(F.array_contains("__rules", r.kind), spans).otherwise(F.array().cast(SPANS))
        out.append(spans.alias(f"__s{k}"))
    return found.select(*docs.columns, *out)


def _joined(columns: list[str], rules: Sequence[Rule]) -> Column:
    """kind:start:end by start, then the rules' order, comma-joined."""

    def numbered(column: str, k: int) -> Column:
        return F.transform(F.col(column), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end")))

    each = [numbered(c, k) for k, c in enumerate(columns)]
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, added: Sequence[Rule] = ADDED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs(doc_id, text); other
    columns are not looked at. Null and empty texts have no spans. A null doc_id stays null and repeated
    rows stay: the index only chooses what is verified, each row is judged by its own text."""
    rules = BASE + tuple(added)
    found = _spans(docs.select("doc_id", "text"), rules)
    columns = [f"__s{k}" for k in range(len(rules))]
    counts = [F.size(c).cast("long").alias(f"n_{r.kind}") for c, r in zip(columns, BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined(columns[: len(BASE)], BASE), 256).alias("base_sha256"), _joined(columns, rules).alias("spans"))


def without(text: Column, spans: Column, mask: str) -> Column:
    """text with its spans, in order, replaced by mask; those that overlap together. What stays is put
    together from blocks of the text, so the time is about in proportion to text and spans."""
    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))

    def piece(cut: Column, start: Column, end: Column) -> Column:
        def part(i: Column) -> Column:
            first = F.greatest(start - i * BLOCK, F.lit(0))
            return F.substring(F.get(cut, i.cast("int")), (first + 1).cast("int"), (F.least(end - i * BLOCK, F.lit(BLOCK)) - first).cast("int"))

        numbers = F.sequence(F.floor(start / BLOCK), F.floor((end - 1) / BLOCK))
        return F.when(start < end, F.array_join(F.transform(numbers, part), "")).otherwise(F.lit(""))

    def clean(s: Column) -> Column:
        covered = running(F.transform(s, lambda x: x["end"]), F.greatest)  # how far the spans up to each reach

        def joined(cut: Column, e: Column) -> Column:
            each = F.transform(s, lambda x, i: F.struct(F.when(i > 0, F.get(e, i - 1)).otherwise(F.lit(0).cast("long")).alias("from"), x["start"].alias("to")))
            stays = F.filter(each, lambda x: x["from"] <= x["to"])
            return F.concat(F.array_join(F.transform(stays, lambda x: F.concat(piece(cut, x["from"], x["to"]), F.lit(mask))), ""), piece(cut, F.element_at(e, -1), F.length(text).cast("long")))

        return let(covered, lambda e: let(blocks, lambda cut: joined(cut, e)))

    return let(spans, clean)


def redact(docs: DataFrame, mask: str = "[secret]", added: Sequence[Rule] = ADDED) -> DataFrame:
    """docs with every span of the scan replaced by mask in text, overlapping ones together; n_chars, if
    there is such a column, is the new length. Texts without spans, nulls among them, stay as they are."""
    rules = BASE + tuple(added)
    found = _spans(docs, rules)
    spans = F.array_sort(F.concat(*[F.col(f"__s{k}") for k in range(len(rules))]))
    found = found.withColumn("__spans", spans)
    found = found.withColumn("text", F.when(F.size("__spans") > 0, without(F.col("text"), F.col("__spans"), mask)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return found.select(*docs.columns)
