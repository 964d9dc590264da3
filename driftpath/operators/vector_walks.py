"""Walks over an index that is small by count: sent to all executors as arrays, all walkers of a batch hop at once.

Draws the same numbers and gives the same walks as the joins do; for indexes of a checked size alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pickers as P
from ..functions.rng import EDGE, GROUP, portable_value  # noqa: F401  (the portable numbers' definition)
from ..storage import importable

_M = np.int64(2147483647)
# The multipliers of the public 64-bit xxHash.
_X1, _X2, _X3, _X4, _X5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = seed + _X5 + np.uint64(8)
    h = _rotl(h ^ (_rotl(x * _X2, 31) * _X1), 27) * _X1 + _X4
    h = (h ^ (h >> np.uint64(33))) * _X2
    h = (h ^ (h >> np.uint64(29))) * _X3
    return h ^ (h >> np.uint64(32))


def hashed(walk: np.ndarray, step: int, slot: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = _hash_long(walk.astype(np.int64).view(np.uint64), np.full(len(walk), 42, np.uint64))
        for v in (step, slot, seed):
            h = _hash_long(np.full(len(walk), v, np.int64).view(np.uint64), h)
    return (h >> np.uint64(11)).astype(float) * 2.0**-53


def portable(walk: np.ndarray, step: int, slot: int, seed: int) -> np.ndarray:
    def power(x):
        sq = x * x % _M
        return sq * sq % _M * x % _M

    x = power((walk * 48271 + (step * 69621 + slot * 40692 + seed * 16807 + 12345) % 2147483647) % _M)
    return power((x + (step * 7919 + slot * 104729 + 1013904223) % 2147483647) % _M) / float(_M)


_MODES = {"hashed": hashed, "portable": portable}


def _below(a: np.ndarray, start: np.ndarray, stop: np.ndarray, target: np.ndarray) -> np.ndarray:
    """How many of a[start:stop], which do not decrease, are below target."""
    lo, hi = start.copy(), stop.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo - start
        mid = (lo + hi) // 2
        less = a[np.minimum(mid, len(a) - 1)] < target
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)


class Arrays:
    """The index by node, group and place."""

    def __init__(self, ends, cums) -> None:
        col = lambda t, n: np.asarray(t.column(n).to_numpy())
        order = np.lexsort((col(ends, "k"), col(ends, "g"), col(ends, "node")))
        node, g = col(ends, "node")[order], col(ends, "g")[order]
        self.nbr, self.ts, self.edge_id, self.succ = (col(ends, n)[order] for n in ("nbr", "ts", "edge_id", "succ"))
        first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (g[1:] != g[:-1])]) if len(node) else np.empty(0, int)
        self.group_start = np.r_[first, len(node)]
        self.group_ts = self.ts[first]
        own = node[first]
        at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, int)
        self.nodes, self.node_start = own[at], np.r_[at, len(own)]
        self.cum = col(cums, "c")[np.lexsort((col(cums, "g"), col(cums, "node")))]
        self.nbr_at = self.find(self.nbr)

    def find(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.nodes):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.nodes, ids), len(self.nodes) - 1)
        return np.where(self.nodes[at] == ids, at, -1)

    def pick(self, name: str, n: np.ndarray, r: np.ndarray, late: bool, base: np.ndarray, lo: np.ndarray) -> np.ndarray:
        if name == P.FIRST:
            return np.zeros(len(n), np.int64)
        if name == P.LAST:
            return n - 1
        if name == P.EXPONENTIAL_WEIGHT:
            start = np.where(lo > 0, self.cum[np.maximum(base + lo - 1, 0)], 0.0)
            target = start + r * (self.cum[base + lo + n - 1] - start)
            return np.minimum(_below(self.cum, base + lo, base + lo + n, target), n - 1)
        d = n.astype(float)
        if name == P.UNIFORM:
            return np.minimum(np.floor(r * n), d - 1).astype(np.int64)
        if name == P.LINEAR:
            k = np.floor((np.sqrt(1.0 + 8.0 * (r * (d * (d + 1.0) / 2.0))) - 1.0) / 2.0)
        else:
            small = np.log1p(r * np.expm1(np.minimum(d, P.EXP_LIMIT - 1)))
            k = np.floor(np.where(n < P.EXP_LIMIT, small, d + np.log(np.maximum(r, 1e-300))))
        k = np.clip(k, 0, d - 1).astype(np.int64)
        return k if late else n - 1 - k

    def walk(self, walk_id, key, rank, cutoff, o, forward: bool, done: int, last: int):
        """rank, cutoff: masked by NaN-free pairs (values, known). Returns lists by hop: (rows, node, ts, edge_id)."""
        at = np.where(key[1], self.find(key[0]), -1)
        ranks, known = rank[0].astype(np.int64), rank[1].copy()
        u = _MODES[o.rng]
        hops = []
        for step in range(done, last):
            rows = np.flatnonzero(at >= 0)
            if not len(rows):
                break
            ni = at[rows]
            base, count = self.node_start[ni], self.node_start[ni + 1] - self.node_start[ni]
            lo = np.where(known[rows], ranks[rows], 0) if forward else np.zeros(len(rows), np.int64)
            hi = count if forward else np.where(known[rows], ranks[rows], count)
            cut = cutoff[1][rows]
            if cut.any():
                early = _below(self.group_ts, base, base + count, cutoff[0][rows])
                hi = np.where(cut, np.minimum(hi, early), hi)
            ok = hi > lo
            at[rows[~ok]] = -1
            rows, base, lo, hi = rows[ok], base[ok], lo[ok], hi[ok]
            if not len(rows):
                break
            name = o.bias if step else o.start_bias or o.bias
            g = base + lo + self.pick(name, hi - lo, u(walk_id[rows], step, GROUP, o.seed), not forward, base, lo)
            size = self.group_start[g + 1] - self.group_start[g]
            if name in (P.FIRST, P.LAST):
                k = np.zeros(len(rows), np.int64)
            else:
                k = np.minimum(np.floor(u(walk_id[rows], step, EDGE, o.seed) * size), size - 1).astype(np.int64)
            e = self.group_start[g] + k
            hops.append((rows, self.nbr[e], self.ts[e], self.edge_id[e]))
            at[rows], ranks[rows], known[rows] = self.nbr_at[e], self.succ[e], True
        return hops


def arrays(index) -> Arrays:
    """Collects the index: only for a size that has been checked."""
    cums = index.stats.select("node", F.posexplode("cum").alias("g", "c"))
    return Arrays(index.ends.select("node", "g", "k", "nbr", "ts", "edge_id", "succ").toArrow(), cums.toArrow())


def run(f: DataFrame, shared, o, forward: bool, done: int, last: int, steps_type: str) -> DataFrame:
    """f: walk_id, key, rank, cutoff, steps -> walk_id, steps with all further hops."""
    importable(f.sparkSession)

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def pair(c):
            return np.asarray(c.fill_null(0)), ~np.asarray(c.is_null())

        kind = pa.struct([("node", pa.int64()), ("ts", pa.int64()), ("edge_id", pa.int64())])
        for b in batches:
            ids = np.asarray(b.column(0))
            hops = shared.value.walk(ids, pair(b.column(1)), pair(b.column(2)), pair(b.column(3)), o, forward, done, last)
            counts = np.zeros(len(ids), np.int64)
            for rows, *_ in hops:
                counts[rows] += 1
            offsets = np.r_[0, np.cumsum(counts)]
            cols = [np.empty(offsets[-1], np.int64) for _ in range(3)]
            for n, (rows, *own) in enumerate(hops):
                for c, v in zip(cols, own, strict=True):
                    c[offsets[rows] + n] = v
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in cols], fields=list(kind)))
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, "hops"])

    out = f.select("walk_id", "key", "rank", "cutoff", "steps").mapInArrow(go, f"walk_id long, key long, rank int, cutoff long, steps {steps_type}, hops {steps_type}")
    return out.select("walk_id", F.concat("steps", "hops").alias("steps"))
