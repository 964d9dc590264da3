"""SimHash fingerprints of word shingles and exact links by Hamming distance through vantage-point trees.

A vantage-point tree over all 64 bits prunes little: distances of unrelated fingerprints crowd around 32 (deviation 4),
so a ball of radius 4 crosses a median boundary about two times in three. The trees here stand on groups of bits: if the
radii of `blocks` groups sum to distance - blocks + 1, two fingerprints within `distance` bits are within the radius of
one group at least, as else they would differ by distance + 1. For 4 bits these are three trees of radius 1, 1 and 0.

A node of a tree deals fingerprints out by their Hamming distance (over the group's bits) to a vantage point; a shard is a
path of such distances. By the triangle inequality a ball of radius r reaches children within r of its centre's alone, and
every flipped bit moves all distances of the path by one at once, so a ball overlaps few shards. A fingerprint is a point
of its own shard and a query of the others that its ball overlaps; of two neighbouring shards the lesser path visits the
greater, which is enough to bring each pair together once. The tree goes on inside the task, where a branch is left out if
the triangle bound excludes it, down to leaves whose pairs are compared over all 64 bits.

The depth of the dealt-out part follows the number of fingerprints. Points and queries of a shard over `shard_cap` are cut
into chunks, and each pair of chunks is a task. A task hands on no pairs but for each fingerprint the least one it is
connected to, so links grow with rows, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, per_text, prepare, sieved, staged

BITS = 64


def fingerprint_of(text: str | None, size: int, seed: int = 42) -> int:
    """Lower-case A-Z, words between white space, shingles of `size` words; a bit is 1 if set in over half of them."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    n = len(begins)
    parts = (
        np.fromiter((digest(joined[b:e], seed) for b, e in zip(begins[at : at + (1 << 14)], ends[at : at + (1 << 14)], strict=True)), np.uint64)
        for at in range(0, n, 1 << 14)
    )
    return majority(parts, n)


def majority(parts: Iterable[np.ndarray], n: int) -> int:
    """The bits that are set in over half of n hashes, which come in parts."""
    ones = np.zeros(BITS, np.int64)
    for h in parts:
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of up to 255 fit a byte
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int(((ones * 2 > n).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


def _printer(shingle: int, seed: int = 42):
    def run(texts: list) -> list:
        import pyarrow as pa

        return [pa.array(np.fromiter((fingerprint_of(x, shingle, seed) for x in texts), np.uint64, len(texts)).view(np.int64))]

    return run


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (long: the fingerprint's 64 bits). A null text counts as empty; no words give 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_text(rows, _printer(shingle, seed), "_dp_fp long").select("doc_id", F.col("_dp_fp").alias("fp"))


def _masks(blocks: int) -> list[int]:
    cuts = [round(BITS * k / blocks) for k in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _radii(distance: int, blocks: int) -> list[int]:
    """Radii of the trees: two prints that differ by more in each group differ by more than `distance` in all."""
    total = max(distance - blocks + 1, 0)
    return [total // blocks + (k < total % blocks) for k in range(blocks)]


def _vantages(block: int, depth: int, seed: int) -> np.ndarray:
    """Vantage points by level: half of the bits differ between any two, so that their distances tell most."""
    return np.random.default_rng(seed * 1000 + block).integers(0, 1 << 63, depth, dtype=np.uint64) * np.uint64(2)


def _paths(fp: np.ndarray, mask: int, points: np.ndarray) -> np.ndarray:
    """The path of each fingerprint as one number, 7 bits a level, the first level highest."""
    out = np.zeros(fp.shape, np.int64)
    for p in points:
        out = out << 7 | np.bitwise_count((fp ^ p) & np.uint64(mask)).astype(np.int64)
    return out


def _flips(mask: int, radius: int) -> np.ndarray:
    """Every change of 1 to radius bits of the mask."""
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return np.array([sum(x) for n in range(1, radius + 1) for x in combinations(bits, n)], np.uint64)


def _visits(fp: np.ndarray, mask: int, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of the shards beyond its own that each fingerprint's ball overlaps, those of greater path."""
    rows, paths = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    flips = _flips(mask, radius)
    step = max(1, (1 << 18) // max(len(flips), 1))
    for at in range(0, len(fp) if len(flips) else 0, step):
        part = fp[at : at + step]
        near = np.sort(_paths(part[:, None] ^ flips[None, :], mask, points), axis=1)
        new = near > _paths(part, mask, points)[:, None]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        i, j = np.nonzero(new)
        rows.append(i + at)
        paths.append(near[i, j])
    return np.concatenate(rows), np.concatenate(paths)


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n the least index connected to it, by links a-b."""
    root = np.arange(n)
    while len(a):
        m = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], m)
        np.minimum.at(new, root[b], m)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root != root[root]).any():
        root = root[root]
    return root


def _split(points: np.ndarray, asked: np.ndarray, mask: int, radius: int, leaf: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tree inside a shard: pairs of index sets (points, queries) that the triangle bound leaves."""
    held = [(np.arange(len(points)), np.arange(len(asked)), 0)]
    m = np.uint64(mask)
    while held:
        p, q, depth = held.pop()
        if len(p) * len(q) <= leaf or depth >= 24:
            yield p, q
            continue
        vantage = points[p[depth * 7919 % len(p)]]
        d, e = (np.bitwise_count((x ^ vantage) & m).astype(int) for x in (points[p], asked[q]))
        low, high = int(d.min()), int(d.max())
        if low == high and e.min() >= low - radius and e.max() <= low + radius:
            held.append((p, q, depth + 4))  # this vantage point tells none of them apart
            continue
        for x in range(low, high + 1):
            own, near = p[d == x], q[abs(e - x) <= radius]
            if len(own) and len(near):
                held.append((own, near, depth + 1))


def _connected(points: np.ndarray, asked: np.ndarray, mask: int, radius: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and the least (as found here) that each is connected to, over all pairs of a point and a query."""
    names, at = np.unique(np.concatenate([points, asked]), return_inverse=True)
    a, b = at[: len(points)], at[len(points) :]
    root = np.arange(len(names))
    got_i, got_j, held = [], [], 0

    def settle():
        nonlocal root, held
        known = np.flatnonzero(root != np.arange(len(names)))
        root = _least(len(names), np.concatenate([known, *got_i]), np.concatenate([root[known], *got_j]))
        got_i.clear()
        got_j.clear()
        held = 0

    for p, q in _split(points, asked, mask, radius):
        for k in range(0, len(p), 256):
            x = p[k : k + 256]
            i, j = np.nonzero(np.bitwise_count(points[x][:, None] ^ asked[q][None, :]) <= distance)
            i, j = a[x[i]], b[q[j]]
            keep = root[i] != root[j]
            got_i.append(i[keep])
            got_j.append(j[keep])
            held += int(keep.sum())
            if held > 1 << 18:
                settle()
    settle()
    k = np.flatnonzero(root != np.arange(len(names)))
    return names[k], names[root[k]]


def links(prints: DataFrame, distance: int = 4, blocks: int | None = None, depth: int | None = None, shard_cap: int = 1 << 15, seed: int = 7) -> DataFrame:
    """Edges (src, dst) among distinct fingerprints (column fp) that connect all within `distance` bits, exactly."""
    spark = prints.sparkSession
    blocks = blocks or (distance + 2) // 2
    masks, radii = _masks(blocks), _radii(distance, blocks)
    prepare(spark)
    if depth is None:  # the fullest shard has about a sixth of its parent's fingerprints
        depth = max(2, min(8, round(math.log(max(prints.count(), 1) / 4096 + 1, 6))))

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fp = np.asarray(b.column(0)).view(np.uint64)
            for k, mask in enumerate(masks):
                points = _vantages(k, depth, seed)
                rows, paths = _visits(fp, mask, points, radii[k])
                shard = np.concatenate([_paths(fp, mask, points), paths]) | (k << 57)
                own = np.arange(len(shard)) < len(fp)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.concatenate([fp, fp[rows]]).view(np.int64)), pa.array(own)], ["shard", "fp", "point"])

    dealt = staged(prints.select("fp").mapInArrow(deal, "shard long, fp long, point boolean"))
    count = F.count(F.lit(1))
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count_if("point") / shard_cap).cast("int").alias("a"), F.ceil(count / shard_cap).cast("int").alias("b"), count.alias("n")).where("n > 1 and a > 0").drop("n")
    met = dealt.join(sizes, "shard")
    chunk = lambda n, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    points = met.where("point").withColumn("i", chunk("a", "point")).withColumn("j", every("b")).withColumn("query", F.lit(False))
    asked = met.withColumn("j", chunk("b", "query")).withColumn("i", every("a")).withColumn("query", F.lit(True))
    tasks = points.unionByName(asked).select("shard", "i", "j", "query", "fp")

    def compare(batches: Iterator) -> Iterator:
        """Batches come in the order of (shard, i, j, query); no more than one such task is held."""
        import pyarrow as pa

        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def done():
            if not held:
                return
            query, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            k = now[0] >> 57
            src, dst = _connected(fp[~query], fp[query], masks[k], radii[k], distance)
            held.clear()
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], ["src", "dst"])

        for b in batches:
            shard, i, j = (np.asarray(b.column(k)) for k in range(3))
            query, fp = np.asarray(b.column(3).to_numpy(zero_copy_only=False)), np.asarray(b.column(4)).view(np.uint64)
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
                if x == y:
                    continue
                key = (int(shard[x]), int(i[x]), int(j[x]))
                if key != now:
                    yield from done()
                    now = key
                held.append((query[x:y], fp[x:y]))
        yield from done()

    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = tasks.repartition(parts, "shard", "i", "j").sortWithinPartitions("shard", "i", "j", "query").mapInArrow(compare, "src long, dst long")
    out._dp_path = dealt._dp_path  # for discard(), once the links are read
    return out


def grouped(prints: DataFrame, distance: int = 4, **kw) -> DataFrame:
    """fp, component and component_id, the least doc_id that links lead to, for the distinct fingerprints of prints (doc_id, fp)."""
    return named(prints, links(staged(prints.select("fp").distinct()), distance, **kw))


def named(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, component (its group) and component_id for the distinct fp of prints (doc_id, fp), by edges (src, dst) among them."""
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(edges)
    group = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = group.groupBy("component").agg(F.min("least").alias("component_id"))
    return group.join(least, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, **kw) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links lead to.

    Rows of equal fingerprint are one class; empty texts have fingerprint zero and link like others. A null doc_id
    takes part and names no component (a group of such alone has none); a repeated row has the component of its class;
    an empty table gives no rows.
    """
    prints = staged(fingerprints(docs, shingle))
    return prints.join(grouped(prints, distance, **kw), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, distance: int = 4, **kw) -> DataFrame:
    """One row of docs for each group: that of least doc_id (of repeated rows any; of groups without ids one a print)."""
    prints = staged(fingerprints(docs, shingle))
    return stay_one(docs, prints, grouped(prints, distance, **kw), _printer(shingle))


def stay_one(docs: DataFrame, prints: DataFrame, groups: DataFrame, printer) -> DataFrame:
    """The rows that stay, by prints (doc_id, fp), groups (fp, component_id), and the printer that makes fp.

    Where an id has rows of several groups, each of those groups keeps its own row; repeated rows of one group leave one.
    """
    stay = staged(groups.where("component_id is not null").select(F.col("component_id").alias("doc_id")).distinct())
    gone = staged(prints.where("doc_id is not null").select("doc_id").distinct().join(stay, "doc_id", "left_anti"))
    # No more texts are shuffled than those that the lesser of the two tables may name.
    if gone.count() <= stay.count():
        met = sieved(docs.where("doc_id is not null"), gone, "doc_id")
        out = met.where("not _dp_met").select(*docs.columns).unionByName(met.where("_dp_met").select(*docs.columns).join(stay, "doc_id", "left_semi"))
    else:
        out = sieved(docs, stay, "doc_id").where("_dp_met").select(*docs.columns).join(stay, "doc_id", "left_semi")
    out = out.select(*docs.columns)
    counts = prints.agg(F.count("doc_id"), F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    if counts[0] != counts[2]:
        # Rows that share an id: the print of each tells its group.
        twice = prints.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
        single = out.join(twice, "doc_id", "left_anti")
        named = per_text(out.join(twice, "doc_id", "left_semi"), printer, "_dp_fp long").join(groups.select(F.col("fp").alias("_dp_fp"), F.col("component").alias("_dp_group"), F.col("component_id").alias("_dp_to")), "_dp_fp")
        out = single.unionByName(named.where("doc_id = _dp_to").dropDuplicates(["_dp_group"]).select(*docs.columns))
    if counts[0] != counts[1]:
        # Rows without an id, of groups in which none has one.
        alone = groups.where("component_id is null").select(F.col("fp").alias("_dp_fp"))
        bare = per_text(docs.where("doc_id is null"), printer, "_dp_fp long").join(alone, "_dp_fp", "left_semi")
        out = out.unionByName(bare.dropDuplicates(["_dp_fp"]).select(*docs.columns))
    return out
