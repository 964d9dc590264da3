"""Best-fit packing of documents into token sequences by a grouping genetic algorithm on islands.

A document's ids end with `end_id`. One longer than `capacity` is cut into pieces of `capacity` ids, of which the first
may be shorter. Pieces of full length are sequences by themselves; the rest is ranked by length and dealt out in turn to
shards of about `shard_items`, so that each shard has the same mix of lengths. On each shard several islands evolve
packings from best-fit-decreasing and shuffled best-fit starts: crossover injects whole well-filled bins of one parent into
another, drops the bins that hold an injected item too, and best-fits the displaced items; between epochs the best packing
of an island moves to the next. A shard whose packing has as few bins as the sum of lengths allows rests; so does one with
a single bin more, if there are other shards to pack that with.

What lies in bins with more than `spare` ids of room is then packed again, over all shards, round by round, until it fits
one shard or a round saves nothing.

Null and empty texts are documents of the end id alone; a null doc_id or a repeated row is packed like any other;
an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import global_rank
from . import tokens
from .common import prepare, staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document (schema PIECES; ids only if asked for)."""
    prepare(docs.sparkSession)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        end = int(end_id).to_bytes(4, "little")
        for b in batches:
            rows: list[tuple] = []
            for doc, raw in zip(b.column(0).to_pylist(), tokens.encoded(tokenizer, b.column(1).to_pylist()), strict=True):
                raw += end
                n = len(raw) // 4
                start, stop, k = 0, (n % capacity or capacity) if n > capacity else n, 0
                while start < n:
                    part = raw[4 * start : 4 * stop]
                    rows.append((doc, k, start, stop - start, zlib.crc32(part), part if with_ids else None))
                    start, stop, k = stop, stop + capacity, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


class _Bins:
    """Bins of item indexes; finds the fullest bin that still takes a length."""

    def __init__(self, capacity: int, lengths: list[int], bins: list[list[int]] = ()) -> None:
        self.capacity, self.lengths, self.bins, self.room = capacity, lengths, [], []
        self.mask, self.by_room = 0, [[] for _ in range(capacity + 1)]
        for b in bins:
            self.add(b)

    def add(self, items: list[int]) -> None:
        room = self.capacity - sum(self.lengths[i] for i in items)
        self.bins.append(items)
        self.room.append(room)
        self._file(len(self.bins) - 1, room)

    def _file(self, k: int, room: int) -> None:
        self.by_room[room].append(k)
        self.mask |= 1 << room

    def put(self, item: int) -> None:
        n = self.lengths[item]
        fits = self.mask >> n
        if not fits:
            self.add([item])
            return
        room = n + (fits & -fits).bit_length() - 1
        held = self.by_room[room]
        k = held.pop()
        if not held:
            self.mask ^= 1 << room
        self.bins[k].append(item)
        self.room[k] = room - n
        self._file(k, room - n)

    def score(self) -> tuple[int, float]:
        """Fewer bins first, then the mean square of how full they are."""
        fill = 1 - np.asarray(self.room) / self.capacity
        return -len(self.bins), float((fill**2).mean()) if len(fill) else 0.0


def _best_fit(capacity: int, lengths: list[int], order) -> _Bins:
    out = _Bins(capacity, lengths)
    for i in order:
        out.put(i)
    return out


def _child(a: _Bins, b: _Bins, rng: np.random.Generator) -> _Bins:
    """b's fullest bins, some of them, whole; a's bins that share no item with those; the displaced, best-fit."""
    room = np.asarray(b.room)
    good = np.flatnonzero(room <= np.quantile(room, 0.6))
    chosen = rng.choice(good, max(1, int(len(good) * rng.uniform(0.2, 0.6))), replace=False)
    inject = [b.bins[k] for k in chosen]
    taken = np.zeros(len(a.lengths), bool)
    taken[[i for x in inject for i in x]] = True
    hit = taken.tolist()
    keep, loose = [], []
    worst = np.quantile(np.asarray(a.room), 0.95)
    for x, r in zip(a.bins, a.room, strict=True):
        if r > 0 and r >= worst or any(hit[i] for i in x):
            loose += [i for i in x if not hit[i]]
        else:
            keep.append(x)
    out = _Bins(a.capacity, a.lengths, [list(x) for x in inject] + [list(x) for x in keep])
    loose.sort(key=a.lengths.__getitem__, reverse=True)
    for i in loose:
        out.put(i)
    return out


def evolve(lengths: list[int], capacity: int, seed: int, generations: int, population: int, given: list[list[list[int]]] = ()) -> list[list[list[int]]]:
    """Packings of the items, best first. given: packings to go on from."""
    rng = np.random.default_rng(seed)
    least = -(-sum(lengths) // capacity)
    down = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    alive = [_Bins(capacity, lengths, [list(b) for b in g]) for g in given] or [_best_fit(capacity, lengths, down)]
    alive.sort(key=_Bins.score, reverse=True)
    size = np.asarray(lengths, float)
    while len(alive) < population and len(alive[0].bins) > least:
        order = np.argsort(-size * rng.uniform(0.8, 1.0, len(size)), kind="stable")
        alive.append(_best_fit(capacity, lengths, order.tolist()))
    for _ in range(generations):
        alive.sort(key=_Bins.score, reverse=True)
        if len(alive[0].bins) <= least or len(alive) < 2:
            break
        i, j = sorted(rng.choice(len(alive), 2, replace=False))
        one, two = (_child(alive[i], alive[j], rng), _child(alive[j], alive[i], rng))
        alive = sorted([*alive, one, two], key=_Bins.score, reverse=True)[:population]
    return [x.bins for x in sorted(alive, key=_Bins.score, reverse=True)]


def _packed(bins: list[list[int]], n: int) -> bytes:
    out = np.empty(n, "<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _unpacked(genome: bytes) -> list[list[int]]:
    at = np.frombuffer(genome, "<i4")
    order = np.argsort(at, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(at[order])) + 1)] if len(at) else []


def pack(items: DataFrame, capacity: int = 1024, shard_items: int = 8192, spare: int | None = None, **kw) -> DataFrame:
    """items has length and any columns; adds sequence_id (long) and offset (long). items must be a staged table."""
    prepare(items.sparkSession)
    spare = capacity // 32 if spare is None else spare
    rows = staged(items.withColumn("_row", F.monotonically_increasing_id()))
    full = rows.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("_row")).withColumn("offset", F.lit(0).cast("long"))
    left = rows.where(F.col("length") < capacity).select("_row", "length")
    places = None
    for level in range(64):
        n = left.count()
        shards = max(1, -(-n // shard_items))
        found = _round(left, shards, level, capacity, **kw)
        if level:
            known = before.agg(F.countDistinct("sequence_id")).first()[0]
            if found.agg(F.countDistinct("sequence_id")).first()[0] >= known:
                places = places.unionByName(before)
                break
        if shards == 1:
            places = found if places is None else places.unionByName(found)
            break
        closed, before = found.where(F.col("room") <= spare), found.where(F.col("room") > spare)
        places = closed if places is None else places.unionByName(closed)
        left = staged(rows.select("_row", "length").join(before.select("_row"), "_row", "left_semi"))
    some = rows.join(places.select("_row", "sequence_id", "offset"), "_row")
    return full.select(*items.columns, "sequence_id", "offset").unionByName(some.select(*items.columns, "sequence_id", "offset"))


def _round(items: DataFrame, shards: int, level: int, capacity: int, islands: int = 2, epochs: int = 2, generations: int = 6, population: int = 4) -> DataFrame:
    """items(_row, length) packed in shards: _row, sequence_id, offset, and the room left in the sequence; staged."""
    ranked = global_rank(items.withColumn("_n", -F.col("length")), ["_n", "_row"], "_rank")
    small = staged(ranked.select("_row", "length", (F.col("_rank") % shards).cast("int").alias("_shard"), F.floor(F.col("_rank") / shards).cast("int").alias("_k")))

    state = "shard int, island int, lengths binary, genomes array<binary>, bins int, least int"

    rest = 1 if shards > 1 else 0  # a bin over the bound is open, and the next round packs it again

    def begin(key, pdf):
        import pandas as pd

        lengths = pdf.sort_values("_k")["length"].to_numpy().astype("<i4")
        first = grown(int(key[0]), 0, lengths, [], 0, 0)
        return pd.DataFrame([{**first, "island": i} for i in range(islands if first["bins"] > first["least"] else 1)])

    def grown(shard, island, lengths, genomes, epoch, generations):
        seed = (shard * 1009 + island) * 31 + epoch
        found = evolve(lengths.tolist(), capacity, seed, generations, population if generations else 1, [_unpacked(bytes(g)) for g in genomes])
        return {
            "shard": shard, "island": island, "lengths": lengths.tobytes(), "genomes": [_packed(b, len(lengths)) for b in found],
            "bins": len(found[0]), "least": int(-(-int(lengths.sum()) // capacity)) + rest,
        }

    def further(epoch):
        def run(key, pdf):
            import pandas as pd

            own = pdf[pdf["home"]].iloc[0]
            genomes = [g for home in (True, False) for gs in pdf[pdf["home"] == home]["genomes"] for g in gs]
            if min(pdf["bins"]) <= own["least"]:
                best = pdf.sort_values("bins", kind="stable").iloc[0]
                return pd.DataFrame([{"shard": int(key[0]), "island": int(key[1]), "lengths": own["lengths"], "genomes": [best["genomes"][0]], "bins": int(best["bins"]), "least": int(own["least"])}])
            return pd.DataFrame([grown(int(key[0]), int(key[1]), np.frombuffer(own["lengths"], "<i4"), genomes, epoch, generations)])

        return run

    on = staged(small.select(F.col("_shard").alias("shard"), "_k", "length").groupBy("shard").applyInPandas(begin, state))
    for epoch in range(epochs):
        open_ = on.where("bins > least")
        if not open_.limit(1).count():
            break
        elite = open_.select("shard", ((F.col("island") + 1) % islands).cast("int").alias("island"), "lengths", F.slice("genomes", 1, 1).alias("genomes"), "bins", "least", F.lit(False).alias("home"))
        grown_on = open_.withColumn("home", F.lit(True)).unionByName(elite).groupBy("shard", "island").applyInPandas(further(epoch), state)
        on = staged(on.where("bins <= least").unionByName(grown_on))

    def placed(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                at, size = np.frombuffer(r.genome, "<i4"), np.frombuffer(r.lengths, "<i4").astype("i8")
                order = np.argsort(at, kind="stable")
                run = np.cumsum(size[order]) - size[order]
                room = capacity - np.bincount(at, size).astype("i8")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                offset = np.empty(len(at), "i8")
                offset[order] = run - np.repeat(run[first], np.diff(np.append(first, len(at))))
                yield pd.DataFrame({"_shard": r.shard, "_k": np.arange(len(at), dtype="i4"), "sequence_id": (level << 57) + r.shard * (1 << 28) + at.astype("i8"), "offset": offset, "room": room[at]})

    best = on.groupBy("shard").agg(F.min_by(F.struct("lengths", F.col("genomes")[0].alias("genome")), F.struct("bins", "island")).alias("b"))
    where = best.select("shard", "b.lengths", "b.genome").mapInPandas(placed, "_shard int, _k int, sequence_id long, offset long, room long")
    return staged(small.join(where, ["_shard", "_k"]).select("_row", "sequence_id", "offset", "room"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False, **kw) -> DataFrame:
    """Pieces of all documents with their place; with_ids adds the ids (binary, little-endian unsigned 32-bit)."""
    out = pack(staged(pieces(docs, tokenizer, end_id, capacity, with_ids)), capacity, **kw)
    return out if with_ids else out.drop("ids")
