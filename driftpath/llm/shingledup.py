"""Near copies by the Jaccard similarity of their sets of word shingles: candidates of SimHash and of MinHash, each verified exactly.

Operator 10's fingerprints, here of these shingles, and its search by vantage-point trees link what differs in 4 bits or
fewer. At a similarity of 0.8 fingerprints differ in 10 bits of 64 and up to 18, and a search of that radius compares
nearly all pairs, so bands of MinHash bring together what the trees do not reach: with 24 bands of 5 values two texts at
0.8 share a band but for 7 in 100,000 cases, and unrelated ones share none. Every pair that is linked has been verified.

Texts of equal sets are one class. All pairs of a small bucket are verified. A larger one is compared with one of its
classes first, which joins nearly all that belongs together by as many pairs as rows. Where classes are left that this
has not connected, all pairs of the bucket are compared in tasks (two chunks each) that hand on one link a class, so
nothing depends on which class came first.

Sets are made anew for the classes that some candidate pair names, and kept for no others: they are as large as the texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard
from . import simhash
from .common import components, per_text, prepare, sieved, staged
from .simhash import _least, named, stay_one

BANDS, ROWS = 24, 5


def hashes_of(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """Hashes of shingles of `size` words (lower-case A-Z, words between white space), repeats included; fewer words are one."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[b:e], seed) for b, e in zip(begins, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(begins))


def shingles_of(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """Their sorted distinct hashes."""
    return np.unique(hashes_of(text, size, seed))


def class_of(own: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(own.tobytes(), 1) if len(own) else 0


def bands_of(own: np.ndarray, mixers: np.ndarray) -> list[int]:
    """One key for each band, of the least values of its ROWS mixing functions; none for an empty set."""
    import xxhash

    if not len(own):
        return []
    least = np.full(mixers.shape[1], np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        x = (own[at : at + 1024, None] ^ mixers[0]) * mixers[1]
        np.minimum(least, x.min(0), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))]


def _mixers() -> np.ndarray:
    x = np.random.default_rng(17).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
    x[1] |= np.uint64(1)
    return x


def _printer(size: int):
    """Class, bands and SimHash fingerprint."""

    def run(texts: list) -> list:
        import pyarrow as pa

        mixers = _mixers()
        classes, keys, sims = [], [], []
        for x in texts:
            h = hashes_of(x, size)
            own = np.unique(h)
            classes.append(class_of(own))
            keys.append(bands_of(own, mixers))
            sims.append(simhash.majority((h[k : k + (1 << 14)] for k in range(0, len(h), 1 << 14)), len(h)))
        signed = lambda x: np.asarray(x, np.uint64).view(np.int64)
        return [pa.array(signed(classes)), pa.array([signed(x) for x in keys], pa.list_(pa.int64())), pa.array(signed(sims))]

    return run


def _set_printer(size: int):
    def run(texts: list) -> list:
        import pyarrow as pa

        sets = [shingles_of(x, size) for x in texts]
        return [pa.array(np.array([class_of(x) for x in sets], np.uint64).view(np.int64)), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))]

    return run


def _class_printer(size: int):
    def run(texts: list) -> list:
        import pyarrow as pa

        return [pa.array(np.array([class_of(shingles_of(x, size)) for x in texts], np.uint64).view(np.int64))]

    return run


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b) whose sets (fp, shingles) have a similarity of `least` or more."""
    x = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").where(both / (F.size("x") + F.size("y") - both) >= least).select("a", "b")


def similar(sets: list, least: float, width: int = 4096) -> np.ndarray:
    """Matrix: which of the sets (sorted distinct values) have a similarity of `least` or more. Values that one set has count by its size alone."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    use = times[at] > 1
    place = np.cumsum(times > 1) - 1
    row, col = row[use], place[at[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((n, n), np.float32)
    for begin in range(0, int((times > 1).sum()), width):
        lo, hi = np.searchsorted(col, [begin, begin + width])
        held = np.zeros((n, width), np.float32)
        held[row[lo:hi], col[lo:hi] - begin] = 1
        both += held @ held.T
    both = both.astype(float)
    return both / (size[:, None] + size[None, :] - both) >= least


def _alike(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes (fp, sim) by operator 10: of equal fingerprints, and of those that its trees link."""
    first = staged(classes.groupBy("sim").agg(F.min("fp").alias("first")))
    equal = classes.join(first, "sim").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    near = simhash.links(first.select(F.col("sim").alias("fp")))
    ends = near.join(first.select(F.col("sim").alias("src"), F.col("first").alias("a")), "src").join(first.select(F.col("sim").alias("dst"), F.col("first").alias("b")), "dst")
    out = staged(equal.union(ends.select("a", "b")))
    discard(first)
    discard(near)
    return out


def links(prints: DataFrame, sets_of: Callable[[DataFrame], DataFrame], least: float = 0.8, small: int = 8, chunk: int = 1024) -> DataFrame:
    """Edges (src, dst) that connect all classes (fp, keys, sim) with similarity `least` that share a band or have near fingerprints.

    sets_of: a table of classes (fp) -> fp, shingles with one row for each of them, others if need be.
    """
    classes = staged(prints.groupBy("fp").agg(F.first("keys").alias("keys"), F.min("sim").alias("sim")))
    alike = _alike(classes.where(F.size("keys") > 0).select("fp", "sim"))
    dealt = classes.select("fp", F.explode("keys").alias("key"))
    dealt = staged(dealt.join(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"))
    few, many = dealt.where(F.col("n") <= small), dealt.where(F.col("n") > small)
    lead = many.groupBy("key").agg(F.min(F.struct(F.xxhash64("fp"), "fp")).alias("l")).select("key", F.col("l.fp").alias("fp2"))
    met = few.join(few.select("key", F.col("fp").alias("fp2")), "key").where("fp < fp2").select("fp", "fp2").union(many.join(lead, "key").where("fp <> fp2").select("fp", "fp2"))
    met = met.union(alike)
    pairs = staged(met.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b")).distinct())
    needed = staged(dealt.select("fp").union(pairs.select("a")).union(pairs.select("b")).distinct())
    discard(classes)
    sets = staged(sets_of(needed).groupBy("fp").agg(F.first("shingles").alias("shingles")))
    good = staged(verified(pairs, sets, least).select(F.col("a").alias("src"), F.col("b").alias("dst")))

    joined = components(good).withColumnRenamed("node", "fp")
    many = many.join(joined, "fp", "left").withColumn("comp", F.coalesce("component", "fp")).drop("component")
    mixed = many.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    many = staged(many.join(mixed, "key").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")))
    own = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("chunks")).cast("int")
    tasks = many.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tasks = tasks.select("key", "fp", "comp", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j")).join(sets, "fp")

    def compare(pdf):
        import pandas as pd

        fp, comp = pdf["fp"].to_numpy(), pdf["comp"].to_numpy()
        i, j = np.nonzero(np.triu(similar(pdf["shingles"].tolist(), least), 1))
        apart = comp[i] != comp[j]
        if not apart.any():
            return pd.DataFrame({"src": fp[:0], "dst": fp[:0]})
        _, to = np.unique(comp, return_inverse=True)
        first = np.full(len(fp), -1)
        first[to[::-1]] = np.arange(len(fp))[::-1]  # one row stands for all of its component
        root = _least(len(fp), first[to[i[apart]]], first[to[j[apart]]])
        k = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"src": fp[k], "dst": fp[root[k]]})

    found = staged(good.union(tasks.groupBy("key", "i", "j").applyInPandas(compare, "src long, dst long")))
    for used in (alike, dealt, pairs, needed, sets, good, many):
        discard(used)
    return found


def one_of_each(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row of docs for each group of near copies: that of least doc_id (of rows without ids one for each group)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = per_text(rows, _printer(shingle), "_dp_fp long, _dp_keys array<long>, _dp_sim long")
    prints = staged(made.select("doc_id", F.col("_dp_fp").alias("fp"), F.col("_dp_keys").alias("keys"), F.col("_dp_sim").alias("sim")))
    ids = staged(prints.select("doc_id", "fp"))

    def sets_of(needed: DataFrame) -> DataFrame:
        """Sets of the texts that the ids of these classes name, and of some others; all rows without an id take part."""
        one = staged(ids.join(needed, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").select("doc_id").distinct())
        texts = sieved(rows, one, "doc_id").where("_dp_met or doc_id is null").select("text")
        return per_text(texts, _set_printer(shingle), "fp long, shingles array<long>").join(needed, "fp", "left_semi")

    edges = links(prints, sets_of, least)
    discard(prints)
    return stay_one(docs, ids, named(ids, edges), _class_printer(shingle))
