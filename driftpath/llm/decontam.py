"""Benchmark decontamination by greedy string tiling of documents with benchmark items.

Texts are words of letters and digits in lower case. Documents that share a run of `seed` words with an item (found by
a running Karp-Rabin hash and then compared word by word) are candidates. For each candidate the longest common run of
unmarked words is marked in both, again and again, down to runs of `tile` words; found again by Karp-Rabin hashes, so
moved passages count as much as those in place. The share of the item's words in tiles is its coverage; at `threshold`
or more the document is contaminated.

The benchmark is used in blocks of at most about `block_words` words, one after the other: a block is small enough to
send to all executors, all documents meet it, and it is let go before the next, so the benchmark's size has no bound. An
item of fewer than `seed` words is its own seed and matches whole. Null and empty texts match nothing; repeated rows are each judged; an empty table gives no rows; with no item nothing matches.
Item ids may be null and may repeat: rows are items by themselves, and the least id that is best is named.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, staged

_WORD = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15
_MANY = 20_000
HITS = "array<struct<item_id:long,coverage:double,words:int>>"


def runs(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `size` ids."""
    n = len(ids) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * np.uint64(_BASE) + ids[k : k + len(h)].astype(np.uint64) + np.uint64(1)
        return h ^ (h >> np.uint64(31))


def tiles(a: np.ndarray, b: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length), longest first; ties by place in a, then in b."""
    if len(a) < tile or len(b) < tile:
        return []
    ha, hb = runs(a, tile), runs(b, tile)
    order = np.argsort(hb, kind="stable")
    low, high = np.searchsorted(hb[order], ha, "left"), np.searchsorted(hb[order], ha, "right")
    if int((high - low).sum()) > _MANY:
        return _dense_tiles(a, b, tile)
    pairs = [(i, int(j)) for i in np.flatnonzero(high > low).tolist() for j in order[low[i] : high[i]] if (a[i : i + tile] == b[j : j + tile]).all()]
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    out = []
    held = set(pairs)
    while held:
        best, most = [], 0
        for i, j in sorted(held):
            if (i - 1, j - 1) in held and free_a[i - 1] and free_b[j - 1]:
                continue  # inside the run that starts before
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                n += 1
            if n > most:
                best, most = [(i, j)], n
            elif n == most:
                best.append((i, j))
        if most < tile:
            break
        for i, j in best:
            if free_a[i : i + most].all() and free_b[j : j + most].all():
                free_a[i : i + most] = False
                free_b[j : j + most] = False
                out.append((i, j, most))
        held = {(i, j) for i, j in held if free_a[i : i + tile].all() and free_b[j : j + tile].all()}
    return out


def _dense_tiles(a: np.ndarray, b: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """The same tiles, for texts that repeat so much that pairs of runs would be too many: one row of lengths at a time."""
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    out = []
    while True:
        most, best = tile, []
        length = np.zeros(len(b) + 1, np.int64)
        for i in range(len(a) - 1, -1, -1):
            same = (b == a[i]) & free_b if free_a[i] else np.zeros(len(b), bool)
            length = np.append(np.where(same, length[1:] + 1, 0), 0)
            top = int(length.max())
            if top >= most:
                if top > most:
                    most, best = top, []
                best.append((i, np.flatnonzero(length == most)))
        if not best:
            return out
        for i, at in reversed(best):
            for j in at.tolist():
                if free_a[i : i + most].all() and free_b[j : j + most].all():
                    free_a[i : i + most] = False
                    free_b[j : j + most] = False
                    out.append((i, j, most))
                    break  # these places of a are taken


class Block:
    """Benchmark items as word ids, with the hashes of their seeds."""

    def __init__(self, items: list[tuple[int | None, str | None]], seed: int, tile: int, threshold: float) -> None:
        self.seed, self.tile, self.threshold = seed, tile, threshold
        words = [(i, _WORD.findall((t or "").lower())) for i, t in items]
        words = [(i, w) for i, w in words if w]
        self.vocab = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in words for w in ws}))}
        self.items = [(i, np.array([self.vocab[w] for w in ws], np.int64)) for i, ws in words]
        #: By length of seed: the hashes of seeds in order, and the items that they belong to.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({min(seed, len(ids)) for _, ids in self.items}):
            pairs = sorted({(int(h), k) for k, (_, ids) in enumerate(self.items) if min(seed, len(ids)) == size for h in runs(ids, size)})
            self.seeds[size] = np.array([h for h, _ in pairs], np.uint64), np.array([k for _, k in pairs], np.int64)

    def judge(self, text: str | None) -> list[dict]:
        if not self.seeds:
            return []
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in _WORD.findall((text or "").lower())], np.int64)
        near_items: set[int] = set()
        for size, (hashes, owner) in self.seeds.items():
            if len(ids) < size:
                continue
            whole = np.convolve(ids > 0, np.ones(size, int), "valid") == size
            found = runs(ids, size)[whole]
            low, high = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
            for x, y in np.unique(np.stack([low, high], 1)[high > low], axis=0):
                near_items.update(owner[x:y].tolist())
        out = []
        for k in sorted(near_items):
            item, own = self.items[k]
            known = np.isin(ids, own)
            near = np.where(known, ids, 0)
            keep = known.copy()  # other words only end runs: one stands for a stretch of them
            keep[1:] |= known[:-1]
            near = near[keep]
            near[near == 0] = -1 - np.arange((near == 0).sum())
            tile = min(self.tile, len(own))
            covered = np.zeros(len(own), bool)
            for at in np.flatnonzero(np.isin(runs(own, tile), runs(near, tile))):
                covered[at : at + tile] = True
            if covered.mean() < self.threshold and self.threshold > 0:
                continue  # tiles can't cover more
            n = sum(x[2] for x in tiles(own, near, tile))
            if n / len(own) >= (1 if len(own) < self.seed else self.threshold):
                out.append({"item_id": item, "coverage": n / len(own), "words": n})
        return out


def contamination(docs: DataFrame, benchmark: DataFrame, seed: int = 5, tile: int = 3, threshold: float = 0.5, block_words: int = 1_000_000) -> DataFrame:
    """docs with _dp_found: the items that each document holds, with coverage and words in tiles."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = bench.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-size // (5 * block_words)))
    rows = docs if blocks == 1 else staged(docs.withColumn("_dp_row", F.monotonically_increasing_id()))
    found = None
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else bench
        block = spark.sparkContext.broadcast(Block([(r.item_id, r.text) for r in part.collect()], seed, tile, threshold))

        def run(texts: list, block=block) -> list:
            import pyarrow as pa

            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("words", pa.int32())]))
            return [pa.array([block.value.judge(x) for x in texts], kind)]

        if blocks == 1:
            return per_text(rows, run, f"_dp_found {HITS}")
        more = staged(per_text(rows.select("_dp_row", F.col("text").cast("string").alias("text")), run, f"_dp_more {HITS}").where(F.size("_dp_more") > 0).select("_dp_row", "_dp_more"))
        block.unpersist()
        found = more if found is None else found.unionByName(more)
    hits = found.groupBy("_dp_row").agg(F.flatten(F.collect_list("_dp_more")).alias("_dp_found"))
    out = rows.join(hits, "_dp_row", "left").withColumn("_dp_found", F.coalesce("_dp_found", F.array().cast(HITS)))
    return out.select(*docs.columns, "_dp_found")


def judged(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """doc_id, contaminated, n_items, item_id (the best covered, null if none), coverage, matched_words, item_ids."""
    rows = contamination(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, **kw)
    best = F.array_min(F.transform("_dp_found", lambda x: F.struct((-x.coverage).alias("c"), x.item_id.alias("i"), x.words.alias("w"))))
    return rows.select(
        "doc_id", (F.size("_dp_found") > 0).alias("contaminated"), F.size("_dp_found").alias("n_items"), best.i.alias("item_id"),
        F.round(F.coalesce(-best.c, F.lit(0.0)), 6).alias("coverage"), F.coalesce(best.w, F.lit(0)).alias("matched_words"),
        F.array_sort(F.transform("_dp_found", lambda x: x.item_id)).alias("item_ids"),
    )
