"""Geohash cells as native expressions, through the integer columns and rows of each level's grid."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the base-32 alphabet of geohashes.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
# ... and the digits that conv() knows.
DIGITS = "0123456789abcdefghijklmnopqrstuv"

MAX_LEVEL = 12


def _bits(v: int, places: tuple[int, ...]) -> int:
    return sum((v >> p & 1) << len(places) - 1 - i for i, p in enumerate(places))


# A character has three bits (16, 4, 1) of the axis that begins it and two (8, 2) of the other; longitude begins the first, then they alternate.
THREE = [_bits(v, (4, 2, 0)) for v in range(32)]
TWO = [_bits(v, (3, 1)) for v in range(32)]
BY_BITS = "".join(ALPHABET[[(a, b) for a, b in zip(THREE, TWO, strict=True)].index((i >> 2, i & 3))] for i in range(32))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def _name(ix: Column, iy: Column, level: int | Column) -> Column:
    """The cell of column ix and row iy."""

    def char(i: int | Column) -> Column:
        if isinstance(i, int):
            x, y = (F.shiftright(v, n - used) for v, n, used in ((ix, -(-5 * level // 2), -(-5 * (i + 1) // 2)), (iy, 5 * level // 2, 5 * (i + 1) // 2)))
            three, two = (x, y) if i % 2 == 0 else (y, x)
        else:
            even = i % 2 == 0
            x = F.call_function("shiftright", ix, (F.ceil(level * 5 / 2) - F.ceil((i + 1) * 5 / 2)).cast("int"))
            y = F.call_function("shiftright", iy, (F.floor(level * 5 / 2) - F.floor((i + 1) * 5 / 2)).cast("int"))
            three, two = F.when(even, x).otherwise(y), F.when(even, y).otherwise(x)
        at = three.bitwiseAND(F.lit(7)) * 4 + two.bitwiseAND(F.lit(3)) + 1
        return F.substring(F.lit(BY_BITS), at.cast("int"), F.lit(1))

    if isinstance(level, int):
        return F.concat(*(char(i) for i in range(level))) if level else F.lit("")
    return F.when(level > 0, F.concat_ws("", F.transform(F.sequence(F.lit(0), level - 1), char))).otherwise(F.lit(""))


def _sizes(level: int | Column) -> tuple[Column, Column]:
    """Numbers of columns and rows at a level, as doubles."""
    if isinstance(level, int):
        return F.lit(float(1 << -(-5 * level // 2))), F.lit(float(1 << 5 * level // 2))
    return F.pow(F.lit(2.0), F.ceil(level * 5 / 2)), F.pow(F.lit(2.0), F.floor(level * 5 / 2))


def encode(lon: Column, lat: Column, level: int) -> Column:
    """The cell of a point; a point on an edge goes to the upper or right cell. Null outside -180..180 x -90..90."""
    nx, ny = _sizes(level)
    ix = F.least(F.floor((lon + 180) * nx / 360), nx.cast("long") - 1)
    iy = F.least(F.floor((lat + 90) * ny / 180), ny.cast("long") - 1)
    return F.when(lon.between(-180, 180) & lat.between(-90, 90), _name(ix, iy, level))


def is_geohash(text: Column) -> Column:
    return text.rlike("^[0-9b-hjkmnp-zB-HJKMNP-Z]{0,12}$")


def grid(gh: Column) -> Column:
    """struct(x: column, y: row, level) of a cell."""
    three, two = (F.array(*(F.lit(v).cast("long") for v in t)) for t in (THREE, TWO))
    zero = F.lit(0).cast("long")

    def step(s: Column, c: Column) -> Column:
        v = F.instr(F.lit(ALPHABET), c)  # from 1
        a, b = F.element_at(three, v), F.element_at(two, v)
        x = F.when(s["even"], s["x"] * 8 + a).otherwise(s["x"] * 4 + b)
        y = F.when(s["even"], s["y"] * 4 + b).otherwise(s["y"] * 8 + a)
        return F.struct(x.alias("x"), y.alias("y"), (~s["even"]).alias("even"))

    chars = F.when(F.length(gh) > 0, F.split(F.lower(gh), "")).otherwise(F.array().cast("array<string>"))
    done = F.aggregate(chars, F.struct(zero.alias("x"), zero.alias("y"), F.lit(True).alias("even")), step)
    return let(done, lambda d: F.struct(d["x"].alias("x"), d["y"].alias("y"), F.length(gh).alias("level")))


def bbox(gh: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax); "" is the world; null where undecodable."""

    def ends(g: Column) -> Column:
        nx, ny = _sizes(g["level"])
        e = (g["x"] * 360 / nx - 180, g["y"] * 180 / ny - 90, (g["x"] + 1) * 360 / nx - 180, (g["y"] + 1) * 180 / ny - 90)
        return F.struct(*(v.alias(n) for v, n in zip(e, ("xmin", "ymin", "xmax", "ymax"), strict=True)))

    return F.when(is_geohash(gh), let(grid(F.when(is_geohash(gh), gh)), ends))


def children(gh: Column) -> Column:
    """The 32 cells of the next level, in order; without a lambda, which would be interpreted and work gh out for each."""
    return F.array(*(F.concat(gh, F.lit(c)) for c in ALPHABET))


def roots() -> Column:
    return F.array(*(F.lit(c) for c in ALPHABET))


def _axis_mask(level: int, lon: bool) -> int:
    """The bits of one axis among a level's, which lie interleaved; the highest is longitude's."""
    return sum(1 << b for b in range(5 * level) if ((5 * level - 1 - b) % 2 == 0) == lon)


_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_VALUES = np.full(256, -1, np.int64)
_VALUES[_LETTERS] = _VALUES[np.frombuffer(ALPHABET.upper().encode(), np.uint8)] = np.arange(32)


def _around(chars: np.ndarray, turns: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the cells around cells of one level (cell, turn, character), and whether each exists. A cell is the number that its characters are in base 32; within the bits of
    one axis a step is one addition, for the other axis's bits, set before, hand the carry on."""
    level = chars.shape[1]
    lon, lat = _axis_mask(level, True), _axis_mask(level, False)
    z = np.zeros(len(chars), np.int64)
    for v in _VALUES[chars].T:
        z = z << 5 | v
    names, there = np.empty((len(chars), len(turns), level), np.uint8), np.ones((len(chars), len(turns)), bool)
    for i, turn in enumerate(turns):
        to = np.zeros(len(z), np.int64)
        for d, mask in zip(turn, (lon, lat), strict=True):
            v = z & mask
            to |= v if d == 0 else ((v | ~mask) + 1 if d > 0 else v - 1) & mask
        if turn[1]:
            there[:, i] = (z & lat) != (lat if turn[1] > 0 else 0)
        names[:, i] = _LETTERS[to[:, None] >> np.arange(5 * (level - 1), -1, -5) & 31]
    return names, there


def neighbors(gh: Column, exclude: bool = False) -> Column:
    """The cell itself (unless excluded), N, NE, E, SE, S, SW, W, NW; columns wrap at the antimeridian, cells beyond a pole are left out. Null for what is no geohash.

    An Arrow kernel over whole batches: as native expressions, the cells and characters are either interpreted lambdas or code too large to be compiled."""
    turns = [(0, 0), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)][exclude:]  # fixed order

    @F.arrow_udf("array<string>")
    def around(cells: pa.Array) -> pa.Array:
        cells = cells.cast(pa.string())
        levels = pc.fill_null(pc.binary_length(cells), -1).to_numpy(zero_copy_only=False)
        order, counts, texts = [], [], []
        for level in np.unique(levels[levels >= 0]):
            at = np.flatnonzero(levels == level)
            if level == 0:
                order, counts, texts = [*order, at], [*counts, np.ones(len(at), np.int64)], [*texts, pa.array([""] * len(at), pa.string())]
            elif level <= MAX_LEVEL:
                chars = np.frombuffer("".join(cells.take(pa.array(at)).to_pylist()).encode(), np.uint8).reshape(len(at), level)
                good = (_VALUES[chars] >= 0).all(1)
                names, there = _around(chars[good], turns)
                flat = np.ascontiguousarray(names[there])
                ends = np.arange(len(flat) + 1, dtype=np.int32) * np.int32(level)
                order, counts = [*order, at[good]], [*counts, there.sum(1)]
                texts.append(pa.Array.from_buffers(pa.string(), len(flat), [None, pa.py_buffer(ends), pa.py_buffer(flat)]))
        if not order:
            return pa.nulls(len(cells), pa.list_(pa.string()))
        order, counts = np.concatenate(order), np.concatenate(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.concat_arrays(texts))
        back = np.full(len(cells), -1, np.int64)
        back[order] = np.arange(len(order))
        return lists.take(pa.array(back, mask=back < 0))

    return around.asNondeterministic()(gh)  # else the optimizer copies the call into a filter of a generator


def encode_long(x: Column) -> Column:
    """The 12 characters of the low 60 bits of an unsigned 64-bit number, given as decimal text."""
    base32 = F.lower(F.conv(x.cast("string"), 10, 32))
    return F.translate(F.substring(F.lpad(base32, 13, "0"), 2, 12), DIGITS, ALPHABET)


def covering_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column, level: int) -> Column:
    """All cells of a level whose closed rectangle touches the box, in descending order."""
    if level == 0:
        return F.array(F.lit(""))
    nx, ny = _sizes(level)
    # a box edge that lies on a cell edge touches the cells on both sides
    x0 = F.greatest(F.ceil((xmin + 180) * nx / 360) - 1, F.lit(0))
    x1 = F.least(F.floor((xmax + 180) * nx / 360), nx.cast("long") - 1)
    y0 = F.greatest(F.ceil((ymin + 90) * ny / 180) - 1, F.lit(0))
    y1 = F.least(F.floor((ymax + 90) * ny / 180), ny.cast("long") - 1)

    def cells(rows: Column) -> Column:
        return F.transform(F.sequence(x0, x1), lambda ix: F.transform(rows, lambda iy: _name(ix, iy, level)))

    return F.sort_array(F.flatten(let(F.sequence(y0, y1), cells)), asc=False)
