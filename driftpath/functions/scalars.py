"""Small scalar functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounded(n: Column, r: Column) -> Column:
    """floor(r * n), below n."""
    return F.least(F.floor(r * n), n - 1)


def boolean(r: Column) -> Column:
    return r >= 0.5


def either(a: Column, b: Column, r: Column) -> Column:
    return F.when(r >= 0.5, a).otherwise(b)


def other(first: Column, second: Column, picked: Column) -> Column:
    return F.when(picked == first, second).otherwise(first)


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, 0)") * F.pow(F.lit(2.0), F.length(F.bin(n - 1))).cast("long"))


def beta_max(p: float, q: float) -> float:
    return max(1.0, 1 / p, 1 / q)


def beta(prev: Column, w: Column, adjacent: Column, p: float, q: float) -> Column:
    """1/p back to the node before, 1 to a neighbour of it, else 1/q; 1 without a node before."""
    return F.when(prev.isNull(), F.lit(1.0)).when(w == prev, F.lit(1 / p)).when(adjacent, F.lit(1.0)).otherwise(F.lit(1 / q))
