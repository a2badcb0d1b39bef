"""Hilbert curve keys of points scaled to a 16-bit grid, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 65535


def scaled(v: Column, low: Column, high: Column) -> Column:
    """Place on the grid, rounded down; 0 where the extent has no width."""
    return F.when(high > low, F.floor(GRID * (v - low) / (high - low))).otherwise(F.lit(0)).cast("long")


def key(x: Column, y: Column) -> Column:
    """Distance along the curve, quadrant by quadrant from the coarsest: each adds its rank and turns what is below it."""
    sides = F.array(*(F.lit(1 << bit).cast("long") for bit in range(15, -1, -1)))

    def quadrant(s: Column, side: Column) -> Column:
        rx, ry = (F.when(s[a].bitwiseAND(side) > 0, F.lit(1)).otherwise(F.lit(0)) for a in "xy")
        lx, ly = (s[a].bitwiseAND(side - 1) for a in "xy")
        flip, turn = (ry == 0) & (rx == 1), ry == 0
        fx, fy = F.when(flip, side - 1 - lx).otherwise(lx), F.when(flip, side - 1 - ly).otherwise(ly)
        d = s["d"] + (rx * 3).bitwiseXOR(ry).cast("long") * side * side
        return F.struct(F.when(turn, fy).otherwise(lx).alias("x"), F.when(turn, fx).otherwise(ly).alias("y"), d.alias("d"))

    return F.aggregate(sides, F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d")), quadrant, lambda s: s["d"])


def key_of(x: int, y: int) -> int:
    """As key, in Python."""
    d = 0
    for bit in range(15, -1, -1):
        side = 1 << bit
        rx, ry = x >> bit & 1, y >> bit & 1
        d += (3 * rx ^ ry) * side * side
        x, y = x & side - 1, y & side - 1
        if ry == 0:
            if rx == 1:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
    return d
