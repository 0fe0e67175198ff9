"""Cell geometry as tokens: quantised anchors, moves by direction and length, and their inverse.

A feature is FEATURE, its tag, four anchor tokens, pairs of direction and length, FEATURE_END."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions import let, neighbours, running

# The layout of the token ids.
ANCHOR, ANCHOR_BLOCK, LENGTH, LONGEST, FEATURE, FEATURE_END, DIRECTION, CELL_END = 300, 23, 444, 64, 509, 510, 511, 260
STEP_M = 0.5
# The first id of the references to a boundary, and the sides and road classes in the order of their ids.
BOUNDARY, BOUNDARY_SIDES, BOUNDARY_CLASSES = 1500, ("N", "E", "S", "W"), ("MAJOR", "MINOR")
# Lengths of the moves of the plain tokenizer, its directions, and the side of its cells.
MOVE_STEPS, MOVE_SIDES = (32, 16, 8, 4, 2, 1), ("N", "E", "S", "W")


def quantise(c: Column) -> Column:
    """To steps of half a metre, halves to even."""
    return F.bround(c / STEP_M).cast("int")


def direction(dx: Column, dy: Column) -> Column:
    """Whole degrees from the x axis, rounded down."""
    degrees = F.degrees(F.atan2(dy, dx))
    return F.pmod(F.floor(F.pmod(degrees, F.lit(360.0))), F.lit(360)).cast("int")


def chunks(quanta: Column) -> Column:
    """A length as pieces of at most 64 quanta, at least one quantum in all."""
    n = F.greatest(F.lit(1), quanta)
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / LONGEST).cast("int")), lambda k: F.least(F.lit(LONGEST), n - k * LONGEST).cast("int"))


def anchor(x: Column, y: Column) -> Column:
    """Four tokens: high and low digit of each quantised coordinate, each in a block of its own."""
    parts = []
    for k, c in enumerate((x, y)):
        q = quantise(c)
        parts += [F.floor(q / ANCHOR_BLOCK).cast("int") + (ANCHOR + 2 * k * ANCHOR_BLOCK), F.pmod(q, F.lit(ANCHOR_BLOCK)) + (ANCHOR + (2 * k + 1) * ANCHOR_BLOCK)]
    return F.array(*parts)


def move(dx: Column, dy: Column) -> Column:
    """Pairs of direction and length tokens."""

    def pairs(m: Column) -> Column:
        one = F.array(m["d"], m["q"] + (LENGTH - 1))
        many = F.flatten(F.transform(chunks(m["q"]), lambda q: F.array(m["d"], q + (LENGTH - 1))))
        return F.when(m["q"] <= LONGEST, one).otherwise(many)

    # The length and the direction are worked out once for each move, and most moves are one piece.
    quanta = F.greatest(F.lit(1), F.bround(F.sqrt(dx * dx + dy * dy) / STEP_M).cast("int"))
    return let(F.struct((direction(dx, dy) + DIRECTION).alias("d"), quanta.alias("q")), pairs)


def moves(points: Column) -> Column:
    """The moves from each point to the next."""
    return F.flatten(F.transform(neighbours(points), lambda e: move(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))


def encode(tag: Column, points: Column) -> Column:
    """points: array of (x, y). All moves are between neighbours."""
    return let(points, lambda p: F.concat(F.array(F.lit(FEATURE), tag.cast("int")), anchor(p[0]["x"], p[0]["y"]), moves(p), F.array(F.lit(FEATURE_END))))


def cost(points: Column) -> Column:
    """Tokens of a feature: 7 and two for each piece of a move."""
    pieces = lambda e: F.ceil(F.greatest(F.lit(1.0), F.bround(F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]) / STEP_M)) / LONGEST).cast("int")
    return let(points, lambda p: F.aggregate(F.transform(neighbours(p), pieces), F.lit(7), lambda a, n: a + 2 * n))


def blocks(tokens: Column) -> Column:
    """The features of a sequence: from a FEATURE to the next FEATURE_END with no other FEATURE between. A
    FEATURE begins anew, a FEATURE_END without one counts for nothing, an unfinished tail is dropped."""
    marked = F.transform(tokens, lambda t, i: F.when(t.isin(FEATURE, FEATURE_END), F.struct(t.alias("t"), i.alias("i"))))
    pairs = let(F.filter(marked, lambda m: m.isNotNull()), neighbours)
    whole = F.filter(pairs, lambda p: (p["a"]["t"] == FEATURE) & (p["b"]["t"] == FEATURE_END))
    return F.transform(whole, lambda p: F.slice(tokens, p["a"]["i"] + 1, p["b"]["i"] - p["a"]["i"] + 1))


def decode_anchor(tokens: Column) -> Column:
    """(x, y) in metres from a block's four anchor tokens."""
    at = lambda k, block: F.get(tokens, F.lit(k)) - (ANCHOR + block * ANCHOR_BLOCK)
    return F.struct(((at(2, 0) * ANCHOR_BLOCK + at(3, 1)) * STEP_M).alias("x"), ((at(4, 2) * ANCHOR_BLOCK + at(5, 3)) * STEP_M).alias("y"))


def decode_end(tokens: Column) -> Column:
    """Where the moves of a block lead: the sum of all from the anchor, in the middle of each degree."""
    pairs = F.sequence(F.lit(6), F.size(tokens) - 3, F.lit(2))
    start = decode_anchor(tokens)

    def step(a: Column, k: Column) -> Column:
        angle = F.radians((F.get(tokens, k) - DIRECTION) + 0.5)
        length = (F.get(tokens, k + 1) - (LENGTH - 1)) * STEP_M
        return F.struct((a["x"] + F.cos(angle) * length).alias("x"), (a["y"] + F.sin(angle) * length).alias("y"))

    return F.when(F.size(tokens) > 7, F.aggregate(pairs, start, step)).otherwise(start)


def terminated(tokens: Column) -> Column:
    """Cells that aren't empty end in CELL_END."""
    return F.when(F.size(tokens) > 0, F.concat(tokens, F.array(F.lit(CELL_END)))).otherwise(tokens)


def prefix_id(position: int, value: Column, kind: str, base: int = 0) -> Column:
    """The id of a conditioning value: 64 to a position; null 0, integers and the first four bytes of a
    string's SHA-256 modulo 63 plus 1."""
    if kind == "int":
        number = F.pmod(value, F.lit(63)) + 1
    else:
        number = F.pmod(F.conv(F.substring(F.sha2(value.cast("binary"), 256), 1, 8), 16, 10).cast("long"), F.lit(63)) + 1
    return (F.lit(base + 64 * position) + F.coalesce(number, F.lit(0))).cast("long")


def thin(points: Column, least: float = 0.5, closed: bool = False) -> Column:
    """Vertices at least so far from the last one kept, and both ends; as it was if too few are left."""

    def step(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        return F.when(F.hypot(p["x"] - last["x"], p["y"] - last["y"]) >= least, F.concat(kept, F.array(p))).otherwise(kept)

    inner = F.aggregate(F.slice(points, F.lit(2), F.greatest(F.lit(0), F.size(points) - 2)), F.slice(points, 1, 1), step)
    out = F.concat(inner, F.slice(points, F.size(points), F.lit(1)))
    return F.when((F.size(points) < 2) | (F.size(out) < (4 if closed else 2)), points).otherwise(out)


def boundary_token(side: Column, road_class: Column) -> Column:
    """The reference to a boundary: null inside the cell, or where no road class is."""
    sides, classes = F.array(*map(F.lit, BOUNDARY_SIDES)), F.array(*map(F.lit, BOUNDARY_CLASSES))
    i, j = F.array_position(sides, side), F.array_position(classes, road_class)
    return F.when((i > 0) & (j > 0), (F.lit(BOUNDARY - 1) + i + len(BOUNDARY_SIDES) * (j - 1)).cast("int"))


def is_boundary(token: Column) -> Column:
    return token.between(BOUNDARY, BOUNDARY + len(BOUNDARY_SIDES) * len(BOUNDARY_CLASSES) - 1)


def encode_part(tag: Column, points: Column, inbound: Column | None = None, outbound: Column | None = None) -> Column:
    """One part in the four forms: with a reference to the boundary that it comes in over (before the anchor), goes out over (in place of
    the last move), both or none. Vertices nearer than a step to the last one kept are left out first."""
    none = F.lit(None).cast("int")
    inbound, outbound = none if inbound is None else inbound, none if outbound is None else outbound
    maybe = lambda t: F.when(t.isNotNull(), F.array(t)).otherwise(F.array().cast("array<int>"))

    def body(p: Column) -> Column:
        closed = F.element_at(p, 1) == F.element_at(p, -1)
        kept = F.when(closed, thin(p, STEP_M, True)).otherwise(thin(p, STEP_M))

        def put(k: Column) -> Column:
            last = F.when(outbound.isNotNull(), F.size(k) - 1).otherwise(F.size(k))
            steps = let(F.slice(k, F.lit(1), F.greatest(F.lit(0), last)), moves)
            return F.concat(F.array(F.lit(FEATURE), tag.cast("int")), maybe(inbound), anchor(k[0]["x"], k[0]["y"]), steps, maybe(outbound), F.array(F.lit(FEATURE_END)))

        return let(kept, put)

    return let(points, body)


def encode_shape(tag: Column, parts: Column, road: Column, sides: Column) -> Column:
    """The parts of a shape one after the other; sides (a map of side to road class) is the contract of its cell. Only roads refer to boundaries:
    by where their ends lie, W before E, N, S."""
    from quadrille.operators.geometry import edge_of

    def one(p: Column) -> Column:
        at = lambda q: edge_of(q["x"], q["y"])
        a, z = at(F.element_at(p, 1)), at(F.element_at(p, -1))
        refer = lambda side: F.when(road & (F.size(p) >= 2), boundary_token(side, F.try_element_at(sides, side)))
        return encode_part(tag, p, refer(a), refer(z))

    return F.flatten(F.transform(parts, one))


def decode_block(block: Column) -> Column:
    """The points of a block: the anchor, then each move in turn; a reference at the end repeats the last point, as the place on the boundary isn't
    written. Null for what isn't a block."""

    def of(b: Column) -> Column:
        first = F.when(is_boundary(F.get(b, F.lit(2))), F.lit(3)).otherwise(F.lit(2))
        out = is_boundary(F.get(b, F.size(b) - 2))
        at = lambda k, block_: F.get(b, first + k) - (ANCHOR + block_ * ANCHOR_BLOCK)
        start = F.struct(((at(0, 0) * ANCHOR_BLOCK + at(1, 1)) * STEP_M).cast("double").alias("x"), ((at(2, 2) * ANCHOR_BLOCK + at(3, 3)) * STEP_M).cast("double").alias("y"))
        stop = F.size(b) - 1 - F.when(out, 1).otherwise(0)  # one past the last move
        n = F.floor((stop - first - 4) / 2).cast("int")

        def step(k: Column) -> Column:
            angle, length = F.radians(F.get(b, first + 4 + 2 * k) - DIRECTION + 0.5), (F.get(b, first + 5 + 2 * k) - (LENGTH - 1)) * STEP_M
            return F.struct((F.cos(angle) * length).alias("x"), (F.sin(angle) * length).alias("y"))

        moves = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), step)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        points = running(F.concat(F.array(start), moves), lambda p, q: F.struct((p["x"] + q["x"]).alias("x"), (p["y"] + q["y"]).alias("y")), 12)
        return F.when((F.get(b, F.lit(0)) == FEATURE) & (F.element_at(b, -1) == FEATURE_END) & (stop >= first + 4), let(points, lambda p: F.when(out, F.concat(p, F.slice(p, F.size(p), F.lit(1)))).otherwise(p)))

    return let(block, of)


def collapsed(block: Column, points: Column) -> Column:
    """Whether a block is a road of which nothing but the ends was left: it goes out over a boundary and has fewer than two different points."""
    return is_boundary(F.get(block, F.size(block) - 2)) & (F.size(F.array_distinct(points)) < 2)


def padded(tokens: Column, length: Column | int, fill: int = 0) -> Column:
    """Filled up on the right."""
    return F.concat(tokens, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(length) - F.size(tokens) if isinstance(length, int) else length - F.size(tokens))))


def dyadic(length: Column) -> Column:
    """A length in metres as steps of 32 to 1, the longest first."""
    parts = []
    rest = length
    for step in MOVE_STEPS:
        parts.append(F.array_repeat(F.lit(step), F.floor(rest / step).cast("int")))
        rest = rest % step
    return F.concat(*parts)


def plain_moves(points: Column) -> Column:
    """Moves along the axes, such as MOVE_E_32; a slanted side has no moves and is an error."""

    def moves(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        side = F.when((dx != 0) & (dy != 0), F.raise_error(F.lit("sides must run along an axis")).cast("string")).when(dx > 0, "E").when(dx < 0, "W").when(dy > 0, "N").otherwise("S")
        length = F.bround(F.greatest(F.abs(dx), F.abs(dy))).cast("int")
        return F.transform(dyadic(length), lambda n: F.concat(F.lit("MOVE_"), side, F.lit("_"), n.cast("string")))

    return F.flatten(F.transform(neighbours(points), moves))


def on_boundary(x: Column, y: Column, side: float = 250.0) -> Column:
    return (x == 0) | (y == 0) | (x == side) | (y == side)


def absorbing_mask(tokens: Column, share: float, seed: str, mask: int) -> Column:
    """tokens with round(share n) of them masked, those of the least digests of seed and place."""

    def of(t: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(t) - 1)
        ranked = F.array_sort(F.transform(places, lambda i: F.struct(F.sha2(F.concat(F.lit(f"{seed}:"), i.cast("string")).cast("binary"), 256).alias("h"), i.alias("i"))))
        chosen = F.transform(F.slice(ranked, F.lit(1), F.bround(F.size(t) * F.lit(share)).cast("int")), lambda r: r["i"])
        return F.when(F.size(t) == 0, t).otherwise(let(chosen, lambda c: F.transform(t, lambda x, i: F.when(F.array_contains(c, i), F.lit(mask)).otherwise(x))))

    return let(tokens, of)
