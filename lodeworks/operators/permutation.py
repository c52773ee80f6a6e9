"""Keyed permutations of 0 .. n-1 as column expressions, in both directions: an order without a table.

The numbers are laid out in a rectangle of about the square root of n on a side.  Rounds shift a number
along its row by a hash of the row, then along its column by a hash of the column (a Feistel network over
two moduli), which can be undone.  Fewer than a side's worth of places lie outside 0 .. n-1; a number that
lands on one goes on until it is back inside, at most ``WALK`` times: always enough up to WALK squared
numbers, and beyond that missed by one in WALK to the power of WALK, which is an error and no wrong number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, WALK = 4, 32


def _shift(key: list[Column], number: Column, side: str, other: Column, size: Column) -> Column:
    said = F.md5(F.concat_ws("|", *key, number.cast("string"), F.lit(side), other.cast("string")))
    return F.conv(F.substring(said, 1, 12), 16, 10).cast("long") % size


def _sides(n: Column) -> tuple[Column, Column]:
    rows = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    return rows, F.call_function("div", n + rows - 1, rows)


def _pair(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _walked(value: Column, n: Column, step: Callable[[Column], Column]) -> Column:
    def back(p: Column) -> Column:
        return F.when(p < n, p).otherwise(F.raise_error(F.lit("a permutation did not come back")).cast("long"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(WALK - 1)), step(value), lambda p, _: F.when(p < n, p).otherwise(step(p)), back)
    outside = F.raise_error(F.concat(F.lit("not in a permutation of "), n, F.lit(": "), value)).cast("long")
    return F.when((value < 0) | (value >= n), outside).otherwise(found)


def place_of(rank: Column, n: Column, *key: Column) -> Column:
    """The number (long) that has ``rank`` in the permutation of 0 .. n-1 by ``key``."""
    rank, n, named = rank.cast("long"), n.cast("long"), [k.cast("string") for k in key]
    rows, columns = _sides(n)

    def turn(s: Column, r: Column) -> Column:
        x = (s["x"] + _shift(named, r, "x", s["y"], rows)) % rows
        return _pair(x, (s["y"] + _shift(named, r, "y", x, columns)) % columns)

    def step(p: Column) -> Column:
        start = _pair(F.call_function("div", p, columns), p % columns)
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["x"] * columns + s["y"])

    return _walked(rank, n, step)


def rank_of(place: Column, n: Column, *key: Column) -> Column:
    """The rank (long) of a number in the permutation of 0 .. n-1 by ``key``: ``place_of`` undone."""
    place, n, named = place.cast("long"), n.cast("long"), [k.cast("string") for k in key]
    rows, columns = _sides(n)

    def turn(s: Column, r: Column) -> Column:
        y = F.pmod(s["y"] - _shift(named, r, "y", s["x"], columns), columns)
        return _pair(F.pmod(s["x"] - _shift(named, r, "x", y, rows), rows), y)

    def step(p: Column) -> Column:
        start = _pair(F.call_function("div", p, columns), p % columns)
        return F.aggregate(F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)), start, turn, lambda s: s["x"] * columns + s["y"])

    return _walked(place, n, step)
