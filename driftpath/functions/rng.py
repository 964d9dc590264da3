"""Stateless uniforms in [0, 1): the same for the same (seed, walk, step, slot), however rows are dealt or retried.

`hashed` is the default. `portable` uses integer arithmetic alone, so another engine can draw the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUP, EDGE, ENDPOINT = 0, 1, 2
_M = 2147483647


def hashed(walk_id: Column, step: int, slot: int, seed: int) -> Column:
    h = F.xxhash64(walk_id.cast("long"), F.lit(step).cast("long"), F.lit(slot).cast("long"), F.lit(seed).cast("long"))
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def _power(x: Column) -> Column:
    square = (x * x) % _M
    return (((square * square) % _M) * x) % _M


def portable(walk_id: Column, step: int, slot: int, seed: int) -> Column:
    fixed = (step * 69621 + slot * 40692 + seed * 16807 + 12345) % _M
    x = _power((walk_id.cast("long") * 48271 + F.lit(fixed)) % _M)
    return _power((x + F.lit((step * 7919 + slot * 104729 + 1013904223) % _M)) % _M).cast("double") / F.lit(float(_M))


def portable_value(walk_id: int, step: int, slot: int, seed: int) -> float:
    x = pow((walk_id * 48271 + (step * 69621 + slot * 40692 + seed * 16807 + 12345) % _M) % _M, 5, _M)
    return pow((x + step * 7919 + slot * 104729 + 1013904223) % _M, 5, _M) / _M


MODES = {"hashed": hashed, "portable": portable}
