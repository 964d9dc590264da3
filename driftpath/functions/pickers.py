"""Inverse-CDF samplers over group indexes [lo, hi): as Column expressions, and as classes for single picks.

`late` favours the end of the range (the reverse order mirrors the index). Every pick of an empty range is null (or -1
for the classes).
"""

from __future__ import annotations

import bisect
import math
import random

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIFORM, LINEAR, EXPONENTIAL_INDEX, EXPONENTIAL_WEIGHT, NODE2VEC, FIRST, LAST = (
    "Uniform", "Linear", "ExponentialIndex", "ExponentialWeight", "TemporalNode2Vec", "First", "Last",
)
ALL = (UNIFORM, LINEAR, EXPONENTIAL_INDEX, EXPONENTIAL_WEIGHT, NODE2VEC, FIRST, LAST)
WEIGHTED = (EXPONENTIAL_WEIGHT, NODE2VEC)
FORWARD, BACKWARD = "Forward_In_Time", "Backward_In_Time"
#: From this size on expm1(n) nears the largest double, and its logarithm is taken as n itself.
EXP_LIMIT = 710


def parse_picker(name: str) -> str:
    if name not in ALL:
        raise ValueError(f"unknown walk bias {name!r}; one of {', '.join(ALL)}")
    return name


def parse_direction(name: str) -> str:
    if name not in (FORWARD, BACKWARD):
        raise ValueError(f"unknown direction {name!r}; {FORWARD} or {BACKWARD}")
    return name


def uniform(n: Column, r: Column) -> Column:
    return F.least(F.floor(r * n), n - 1)


def linear(n: Column, r: Column, late: bool) -> Column:
    d = n.cast("double")
    k = F.least(F.floor((F.sqrt(F.lit(1.0) + F.lit(8.0) * (r * (d * (d + 1.0) / 2.0))) - 1.0) / 2.0), n - 1)
    return k if late else n - 1 - k


def exponential_index(n: Column, r: Column, late: bool) -> Column:
    small = F.log1p(r * F.expm1(F.least(n, F.lit(EXP_LIMIT - 1)).cast("double")))
    large = n + F.log(F.greatest(r, F.lit(1e-300)))
    k = F.greatest(F.least(F.floor(F.when(n < EXP_LIMIT, small).otherwise(large)), n - 1), F.lit(0))
    return k if late else n - 1 - k


def weighted(cum: Column, lo: Column, hi: Column, r: Column) -> Column:
    """The first index from lo on whose cumulative weight reaches the target; flat stretches give their first."""
    start = F.when(lo > 0, F.get(cum, lo - 1)).otherwise(F.lit(0.0))
    target = start + r * (F.get(cum, hi - 1) - start)
    below = F.size(F.filter(F.slice(cum, lo + 1, F.greatest(hi - lo, F.lit(0))), lambda x: x < target))
    return F.least(lo + below, hi - 1)


def pick(name: str, lo: Column, hi: Column, r: Column, late: bool, cum: Column | None = None) -> Column:
    """The picked index as int, null where hi <= lo."""
    n = hi - lo
    if name == FIRST:
        k = lo
    elif name == LAST:
        k = hi - 1
    elif name == UNIFORM:
        k = lo + uniform(n, r)
    elif name == LINEAR:
        k = lo + linear(n, r, late)
    elif name == EXPONENTIAL_INDEX:
        k = lo + exponential_index(n, r, late)
    else:
        k = weighted(cum, lo, hi, r)
    return F.when(n > 0, k.cast("int"))


class _Picker:
    """Single picks. use_gpu is accepted and has no effect; `seed` makes the picks repeatable."""

    def __init__(self, use_gpu: bool = False, seed: int | None = None) -> None:
        self._random = random.Random(seed)

    def at(self, n: int, r: float) -> int:
        raise NotImplementedError

    def pick_random(self, start: int, end: int, prioritize_end: bool = True) -> int:
        return self.pick_with(start, end, prioritize_end, self._random.random())

    def pick_with(self, start: int, end: int, prioritize_end: bool, r: float) -> int:
        n = end - start
        if n <= 0:
            return -1
        k = max(0, min(self.at(n, r), n - 1))
        return start + (k if prioritize_end else n - 1 - k)


class LinearRandomPicker(_Picker):
    def at(self, n: int, r: float) -> int:
        return int((math.sqrt(1 + 8 * (r * (n * (n + 1) / 2))) - 1) / 2)


class ExponentialIndexRandomPicker(_Picker):
    def at(self, n: int, r: float) -> int:
        return int(math.log1p(r * math.expm1(n)) if n < EXP_LIMIT else n + math.log(max(r, 1e-300)))


class UniformRandomPicker(_Picker):
    def at(self, n: int, r: float) -> int:
        return int(r * n)

    def pick_with(self, start: int, end: int, prioritize_end: bool, r: float) -> int:
        return super().pick_with(start, end, True, r)


class WeightBasedRandomPicker:
    def __init__(self, use_gpu: bool = False, seed: int | None = None) -> None:
        self._random = random.Random(seed)

    def pick_random(self, cumulative_weights: list[float], group_start: int, group_end: int) -> int:
        return self.pick_with(cumulative_weights, group_start, group_end, self._random.random())

    def pick_with(self, cumulative_weights: list[float], group_start: int, group_end: int, r: float, base: int = 0) -> int:
        """base: where the node's own slice begins in the weights."""
        if group_start < 0 or group_end <= group_start or group_end > len(cumulative_weights):
            return -1
        low = cumulative_weights[group_start - 1] if group_start > base else 0.0
        target = low + r * (cumulative_weights[group_end - 1] - low)
        return min(bisect.bisect_left(cumulative_weights, target, group_start, group_end), group_end - 1)
