"""H3 cells by their published bit layout, as native expressions over the 64-bit index.

Mode is bits 59-62, resolution 52-55, base cell 45-51, then 15 digits of three bits each, 7 where unused.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolith.functions.geohash import let

MAX_RES = 15
# The base cells that are pentagons.
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)


def from_text(text: Column) -> Column:
    """Index of a cell's hexadecimal text, as bigint."""
    return F.conv(text, 16, 10).cast("long")


def to_text(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def resolution(cell: Column) -> Column:
    return F.shiftright(cell, 52).bitwiseAND(F.lit(15)).cast("int")


def base_cell(cell: Column) -> Column:
    return F.shiftright(cell, 45).bitwiseAND(F.lit(127)).cast("int")


def _digit(cell: Column, r: int) -> Column:
    return F.shiftright(cell, 3 * (MAX_RES - r)).bitwiseAND(F.lit(7))


def _set_resolution(cell: Column, r: Column) -> Column:
    return cell.bitwiseAND(F.lit(~(15 << 52))).bitwiseOR(F.expr("shiftleft(cast(1 as bigint), 52)") * r.cast("long"))


def _digits(cell: Column) -> Column:
    """The digits that the resolution uses."""
    every = F.array(*(_digit(cell, r) for r in range(1, MAX_RES + 1)))
    return F.slice(every, F.lit(1), resolution(cell))


def is_pentagon(cell: Column) -> Column:
    return base_cell(cell).isin(*PENTAGONS) & F.forall(_digits(cell), lambda d: d == 0)


def is_valid(cell: Column) -> Column:
    """Mode 1, a known base cell, digits below 7 where used and 7 beyond, and no deleted pentagon branch."""
    ok = (F.shiftright(cell, 56).bitwiseAND(F.lit(255)) == 8) & (base_cell(cell) < 122)
    for r in range(1, MAX_RES + 1):
        ok = ok & ((resolution(cell) >= r) == (_digit(cell, r) < 7))
    lead = F.get(F.filter(_digits(cell), lambda d: d != 0), F.lit(0))  # the first digit that isn't 0
    return F.coalesce(ok & ~(base_cell(cell).isin(*PENTAGONS) & F.coalesce(lead == 1, F.lit(False))), F.lit(False))


def parent(cell: Column, res: Column | int | None = None) -> Column:
    """The cell of a coarser resolution (one step without res); null where that isn't coarser."""
    own = resolution(cell)
    to = own - 1 if res is None else (F.lit(res) if isinstance(res, int) else res)
    rest = F.lit(0).cast("long")
    for r in range(MAX_RES, 0, -1):
        rest = rest.bitwiseOR(F.when(to < r, F.lit(7 << 3 * (MAX_RES - r)).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.when((to >= 0) & (to < own), _set_resolution(cell, to).bitwiseOR(rest))


def child_steps(cell: Column, to: Column) -> Column:
    """Child numbers below a cell: 7 ** steps of them, whatever the cell."""
    return F.pow(F.lit(7.0), to - resolution(cell)).cast("long")


def children(cell: Column, res: int | None = None) -> Column:
    """Array of the cells of a finer resolution (one step without res) in ascending order; null where that isn't finer."""
    own = resolution(cell)
    to = own + 1 if res is None else F.lit(res)
    step = F.when((to > own) & (to <= MAX_RES), F.sequence(F.lit(0).cast("long"), child_steps(cell, to) - 1))
    start = _set_resolution(cell, to)
    free = F.lit(0).cast("long")
    for r in range(1, MAX_RES + 1):
        free = free + F.when((own < r) & (to >= r), F.lit(7 << 3 * (MAX_RES - r)).cast("long")).otherwise(F.lit(0).cast("long"))

    def place(base: Column) -> Column:
        def child(i: Column) -> Column:
            out = base
            for r in range(1, MAX_RES + 1):
                d = (F.floor(i / F.pow(F.lit(7.0), to - r)).cast("long") % 7) * F.lit(1 << 3 * (MAX_RES - r)).cast("long")
                out = out + F.when((own < r) & (to >= r), d).otherwise(F.lit(0).cast("long"))
            return out

        return F.filter(F.transform(step, child), is_valid)

    return let(start.bitwiseAND(F.bitwise_not(free)), place)
