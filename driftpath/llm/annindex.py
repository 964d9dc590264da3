"""Near-duplicate embeddings by a robust-pruned flat graph, searched by range from medoids and verified.

Vectors of one label (and length) are dealt to overlapping cells around sampled centroids. A vector's home is its nearest
centroid; it also visits every cell whose border is within half the linking radius of it. If two vectors at the threshold
have different homes, the border between those is within that half of one of them, so that they meet in a home of one
of the two: dealing loses no link. Cells that are still large are split again by centroids of their own (a tree, with no
bound on the number of cells and no centroids on the driver), unless the split would send most vectors to most cells.
What is large after that is cut into chunks, and each pair of a chunk of points and a chunk of queries is a task.

A task builds a graph over its points: overlapping shards around own centroids, a robust-pruned list for each point of a
shard, the lists of all shards united. Every row of the cell is a query: a greedy search with a bounded beam from the
shards' medoids, then an expansion through all nodes within the range. Some queries of each task are audited against
brute force; while recall is under `recall`, the beam doubles, and at last the task is scanned. Found pairs are verified
by cosine in double precision.

Equal vectors of a label are one class. A pair is counted in one of the cells that both are in, settled by their homes,
and no pairs leave a task: each vector hands on the sum of its partners' rows and the least vector it is connected to.

Vectors that are null, empty, zero, or hold a null or a number that is not finite, and those without a label, link
with nothing. Repeated ids are rows by themselves; a null id takes part and names no component. Lengths may differ:
vectors of different lengths do not link. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, prepare, staged
from .simhash import _least


def robust_prune(near: np.ndarray, sims: np.ndarray, s: np.ndarray, degree: int, alpha: float = 1.2) -> np.ndarray:
    """By row, up to `degree` of the candidates `near` (best first, similarities `sims`; s: similarity of all pairs).

    A candidate goes if a kept one is nearer to it, by the factor alpha of the (Euclidean) distance, than the row is.
    Rows are worked on together; -1 fills up.
    """
    n, c = near.shape
    alive = near >= 0
    own = np.sqrt(np.maximum(2 - 2 * sims, 0))
    out = np.full((n, degree), -1, np.int64)
    rows = np.arange(n)
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        at = alive.argmax(1)
        picked = near[rows, at]
        out[some, k] = picked[some]
        between = np.sqrt(np.maximum(2 - 2 * s[picked[:, None], near], 0))
        alive &= ~(some[:, None] & (alpha * between <= own))
        alive[rows, at] = False
    return out


class Graph:
    """A flat graph over the rows of x (unit vectors): shards around own centroids, pruned, united."""

    def __init__(self, x: np.ndarray, shard: int = 256, overlap: int = 2, candidates: int = 32, degree: int = 12, far: int = 6, seed: int = 3) -> None:
        self.x = x
        n = len(x)
        rng = np.random.default_rng(seed)
        k = max(1, -(-n // shard))
        centres = x[rng.choice(n, k, replace=False)]
        home = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :overlap]
        links: list[np.ndarray] = []
        self.medoids: list[int] = []
        for c in range(k):
            at = np.flatnonzero((home == c).any(1))
            for part in np.array_split(rng.permutation(at), max(1, -(-len(at) // (4 * shard)))) if len(at) > 4 * shard else [at]:
                if not len(part):
                    continue
                v = x[part]
                s = v @ v.T
                self.medoids.append(int(part[int(s.sum(1).argmax())]))
                if len(part) < 2:
                    continue
                np.fill_diagonal(s, -2)
                m = min(candidates, len(part) - 1)
                near = np.argpartition(-s, m - 1, axis=1)[:, :m]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
                np.fill_diagonal(s, 1)
                # Members drawn at random are pruned apart: a dense group would fill its lists with itself and be an island.
                wide = rng.integers(0, len(part), (len(part), 4 * far))
                wide = np.take_along_axis(wide, np.argsort(-np.take_along_axis(s, wide, 1), axis=1, kind="stable"), 1)
                wide[wide == np.arange(len(part))[:, None]] = -1
                for some, most in ((near, degree), (wide, far)):
                    kept = robust_prune(some, np.take_along_axis(s, some, 1), s, min(most, m))
                    i, j = np.nonzero(kept >= 0)
                    a, b = part[i], part[kept[i, j]]
                    links += [np.stack([a, b], 1), np.stack([b, a], 1)]  # both ways, so that each node can be reached
        pairs = np.unique(np.concatenate(links), axis=0) if links else np.empty((0, 2), np.int64)
        self.medoids = sorted(set(self.medoids))
        start = np.searchsorted(pairs[:, 0], np.arange(n + 1))
        most = min(int(np.diff(start).max(initial=0)), 4 * degree)
        self.next = np.full((n, max(most, 1)), -1, np.int64)
        for i in range(n):
            to = pairs[start[i] : start[i + 1], 1]
            if len(to) > most:  # the nearest, and a spread of the others
                to = to[np.argsort(-(x[to] @ x[i]), kind="stable")]
                to = np.concatenate([to[: most // 2], to[most // 2 :: max(1, 2 * (len(to) - most // 2) // most)]])[:most]
            self.next[i, : len(to)] = to

    def _fresh(self, asked: np.ndarray, seen: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbours of nodes that their queries (rows) have not seen, sorted by query, with their similarity."""
        n = len(self.x)
        to = self.next[nodes]
        i, j = np.nonzero(to >= 0)
        key = np.unique(rows[i] * n + to[i, j])
        rows, to = key // n, key % n
        new = ~seen[rows, to]
        rows, to = rows[new], to[new]
        seen[rows, to] = True
        score = np.empty(len(rows), np.float32)
        for at in range(0, len(rows), 1 << 14):
            a, b = rows[at : at + (1 << 14)], to[at : at + (1 << 14)]
            score[at : at + (1 << 14)] = np.einsum("ij,ij->i", asked[a], self.x[b])
        return rows, to, score

    def search(self, asked: np.ndarray, radius: float, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(place in asked, node) of all nodes found with similarity >= radius. Each query keeps its `beam` best alone."""
        n, q = len(self.x), len(asked)
        seen = np.zeros((q, n), bool)
        first = asked @ self.x[self.medoids].T
        seen[:, self.medoids] = True
        beam, width = max(beam, width), min(width, n)
        ids = np.full((q, beam), -1, np.int64)
        score = np.full((q, beam), -3.0, np.float32)  # -3: empty
        open_ = np.zeros((q, beam), bool)
        held = min(beam, len(self.medoids))
        top = np.argsort(-first, axis=1, kind="stable")[:, :held]
        ids[:, :held] = np.asarray(self.medoids)[top]
        score[:, :held] = np.take_along_axis(first, top, 1)
        open_[:, :held] = True
        r, m = np.nonzero(first >= radius)
        found = [(r, np.asarray(self.medoids)[m])]
        active = np.arange(q)
        while len(active):
            level = np.where(open_[active], score[active], -4.0)
            best = np.argpartition(-level, min(width, beam) - 1, axis=1)[:, :width]
            going = np.take_along_axis(level, best, 1) > -3
            i, j = np.nonzero(going)
            rows, at = active[i], best[i, j]
            open_[rows, at] = False
            rows, to, s = self._fresh(asked, seen, rows, ids[rows, at])
            if len(rows):
                near = s >= radius
                found.append((rows[near], to[near]))
                own, begin, times = np.unique(rows, return_index=True, return_counts=True)
                place = np.arange(len(rows)) - np.repeat(begin, times)
                line = np.repeat(np.arange(len(own)), times)
                wide = beam + int(times.max())
                a, b, c = np.full((len(own), wide), -1, np.int64), np.full((len(own), wide), -3.0, np.float32), np.zeros((len(own), wide), bool)
                a[:, :beam], b[:, :beam], c[:, :beam] = ids[own], score[own], open_[own]
                a[line, beam + place], b[line, beam + place], c[line, beam + place] = to, s, True
                top = np.argpartition(-b, beam - 1, axis=1)[:, :beam]
                ids[own], score[own], open_[own] = (np.take_along_axis(x, top, 1) for x in (a, b, c))
            active = active[open_[active].any(1)]
        rows, nodes = (np.concatenate(x) for x in zip(*found, strict=True))
        out = [(rows, nodes)]
        while len(rows):  # all that is within the range of the query, through nodes that are
            rows, nodes, s = self._fresh(asked, seen, rows, nodes)
            rows, nodes = rows[s >= radius], nodes[s >= radius]
            out.append((rows, nodes))
        rows, nodes = (np.concatenate(x) for x in zip(*out, strict=True))
        return rows, nodes


def range_links(points: np.ndarray, asked: np.ndarray, threshold: float, recall: float, audit_every: int = 20, beam: int = 16, slack: float = 1e-4, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified (i, j), asked[i] within the threshold of points[j], in blocks of queries (a vector itself included)."""
    low, queries = points.astype(np.float32), asked.astype(np.float32)
    n = len(points)
    graph = Graph(low)
    audit = np.arange(0, len(asked), audit_every)
    while beam < n:
        got = true = 0
        for at in range(0, len(audit), block):
            rows = audit[at : at + block]
            want = queries[rows] @ low.T >= threshold + slack
            i, j = graph.search(queries[rows], threshold, beam)
            got, true = got + int(want[i, j].sum()), true + int(want.sum())
        if got >= recall * true:
            break
        beam *= 2
    for at in range(0, len(asked), block):
        own = queries[at : at + block]
        i, j = graph.search(own, threshold - slack, beam) if beam < n else np.nonzero(own @ low.T >= threshold - slack)
        i = i + at
        exact = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 14):
            exact[k : k + (1 << 14)] = np.einsum("ij,ij->i", asked[i[k : k + (1 << 14)]], points[j[k : k + (1 << 14)]]) >= threshold
        yield i[exact], j[exact]


def cell_links(x: np.ndarray, want, threshold: float, recall: float, **kw) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links (i, j), i != j, both ways, among the rows of x, in blocks. want(i, j) says which pairs are asked for."""
    for i, j in range_links(x, x, threshold, recall, **kw):
        keep = i != j if want is None else (i != j) & want(i, j)
        yield i[keep], j[keep]


def _matrix(column) -> np.ndarray:
    """A list column of one length as rows of doubles, scaled to unit length."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    x = np.asarray(flat.flatten(), float).reshape(len(flat), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def borders(x: np.ndarray, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each row of x, and the matrix of cells that it is in: those with a border to the home within radius / 2."""
    s = x @ centres.T
    own = s.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))
    inside = s[np.arange(len(x)), own][:, None] - s <= (radius / 2 + 1e-6) * apart[own] + 1e-9
    inside[np.arange(len(x)), own] = True
    return own, inside


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows with `ok`; classes of equal (label, vector): least vec_id and number of rows."""
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    kind = kind if kind == "float" else "double"
    v = F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & fine, F.lit(False)))
    same = rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("w"))
    return rows, same


def _split(state: DataFrame, radius: float, cell: int, cell_cap: int, fan: int, most: float, block: int) -> tuple[DataFrame, DataFrame] | None:
    """(cells that stay, cells one level down), or None if no cell is over cell_cap points.

    Centroids are rows whose content hashes low, so the cells do not depend on how rows are dealt out.
    """
    size = state.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("point").alias("points"))
    big = staged(size.where(F.col("points") > cell_cap).select("key", "n", F.least(F.lit(fan), F.ceil(F.col("n") / cell)).cast("int").alias("k"), F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    if big.limit(1).count() == 0:
        return None
    spread = 1 << 30
    part = state.join(big, "key")
    low = F.pmod(F.xxhash64("h", F.lit("centre"), F.size("path")), F.lit(spread))
    some = part.where(low < F.lit(float(spread)) * (2 * F.col("k") + 16) / F.col("n")).select("key", "v", "c", "k", "blocks", low.alias("low"))
    centres = some.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("low", "v"))).where("r <= k")
    names = state.columns
    rows = part.withColumn("block", F.pmod(F.xxhash64("h", F.lit("block")), F.col("blocks")).cast("int")).withColumn("centre", F.lit(0))
    heads = centres.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    heads = heads.select(*[F.col(n) if n in ("key", "v", "c") else F.lit(None).cast(state.schema[n].dataType).alias(n) for n in names], "block", F.col("r").alias("centre"))
    fields = [n for n in names if n != "v"]

    def route(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        head = table.filter(pc.greater(table["centre"], 0)).sort_by("centre")
        own = table.filter(pc.equal(table["centre"], 0))
        homes, lists = [np.empty(0, np.int64)], []
        if len(head):
            mid = _matrix(head["v"])
            for at in range(0, len(own), 1024):
                home, inside = borders(_matrix(own["v"][at : at + 1024]), mid, radius)
                homes.append(home)
                r, j = np.nonzero(inside)
                lists += [x.tolist() for x in np.split(j, np.cumsum(np.bincount(r, minlength=len(home)))[:-1])]
        else:
            homes, lists = [np.zeros(len(own), np.int64)], [[0]] * len(own)
        cols = [own[n] for n in fields] + [own["v"], pa.array(np.concatenate(homes), pa.int32()), pa.array(lists, pa.list_(pa.int32()))]
        return pa.table(cols, names=[*fields, "v", "own", "into"])

    kind = state.schema["v"].dataType.elementType.typeName()
    ddl = ", ".join(f"{n} {state.schema[n].dataType.simpleString()}" for n in fields) + f", v array<{kind}>, own int, into array<int>"
    routed = staged(rows.select(*names, "block", "centre").unionByName(heads).groupBy("key", "block").applyInArrow(route, ddl))
    worth = routed.groupBy("key").agg(F.avg(F.size("into")).alias("copies")).join(big, "key").where(F.col("copies") <= most * F.col("k")).select("key")
    worth = staged(worth)
    stay = state.join(worth, "key", "left_anti")
    to = F.col("to")
    down = routed.join(worth, "key").withColumn("to", F.explode("into")).select(
        F.concat_ws(".", "key", to).alias("key"), F.concat("path", F.array(to)).alias("path"), F.concat("owns", F.array("own")).alias("owns"),
        F.concat("cells", F.array("into")).alias("cells"), (to == F.col("own")).alias("point"), "c", "h", "w", "v",
    )
    return stay, down


def _meets(path: list, owns: np.ndarray, cells: list) -> callable:
    """Which pairs (i, j) of rows are counted in the cell at `path`: at each level the least home of the two that both are in."""
    known = []
    for level in range(len(path)):
        held = [np.asarray(x[level]) for x in cells]
        rows = np.repeat(np.arange(len(held)), [len(x) for x in held])
        known.append(np.sort(rows * (1 << 20) + np.concatenate(held)) if held else np.empty(0, np.int64))

    def has(level, rows, cell):
        key = rows * (1 << 20) + cell
        at = np.minimum(np.searchsorted(known[level], key), len(known[level]) - 1)
        return known[level][at] == key

    def wanted(i, j):
        out = np.ones(len(i), bool)
        for level, t in enumerate(path):
            a, b = owns[i, level], owns[j, level]
            far = 1 << 20
            out &= np.minimum(np.where(has(level, j, a), a, far), np.where(has(level, i, b), b, far)) == t
        return out

    return wanted


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, cell: int = 4096, cell_cap: int = 8192, recall: float = 0.995, fan: int = 1024, most: float = 0.5, levels: int = 6
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vector.

    Cells of over cell_cap points are split by up to `fan` centroids, one for about `cell` rows, where a row then goes to no
    more than the share `most` of the new cells on average; `levels` bounds the depth, and chunks do the rest exactly.
    """
    spark = vectors.sparkSession
    prepare(spark)
    radius = float(np.sqrt(2 - 2 * threshold))
    rows, same = classes(vectors)
    same = staged(same.withColumn("c", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("v")).withColumn("g", F.concat_ws(":", F.size("v"), F.col("label").cast("string"))))
    none = F.array().cast("array<int>")
    state = same.select(
        F.col("g").alias("key"), none.alias("path"), none.alias("owns"), F.array().cast("array<array<int>>").alias("cells"), F.lit(True).alias("point"), "c", "h", "w", "v",
    )
    settled = None
    for _ in range(levels):
        found = _split(state, radius, cell, cell_cap, fan, most, 8192)
        if found is None:
            break
        settled = found[0] if settled is None else settled.unionByName(found[0])
        state = staged(found[1])
    state = state if settled is None else staged(settled.unionByName(state))

    size = state.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.ceil(F.count_if("point") / cell_cap).cast("int").alias("a"), F.ceil(F.count(F.lit(1)) / (4 * cell_cap)).cast("int").alias("b")
    ).where("n > 1 and a > 0").drop("n")
    met = state.join(size, "key")
    points = met.where("point").withColumn("pa", F.pmod(F.xxhash64("h", F.lit("chunk")), F.col("a")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    asked = met.withColumn("qb", F.pmod(F.xxhash64("h", F.lit("query")), F.col("b")).cast("int")).withColumn("pa", F.explode(F.sequence(F.lit(0), F.col("a") - 1)))
    tasks = points.withColumn("query", F.lit(False)).unionByName(asked.withColumn("query", F.lit(True))).drop("a", "b")

    def link(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        p, q = table.filter(pc.invert(table["query"])), table.filter(table["query"])
        nothing = pa.table({"c": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        if not len(p) or not len(q):
            return nothing
        both = pa.concat_tables([p, q])
        c, h, w = (both[n].to_numpy() for n in ("c", "h", "w"))
        ids, at = np.unique(c, return_inverse=True)
        weight = np.zeros(len(ids), np.int64)
        weight[at] = w
        path = p["path"][0].as_py()
        owns = np.array(both["owns"].to_pylist(), int).reshape(len(both), len(path))
        wanted = _meets(path, owns, both["cells"].to_pylist() if path else [])
        visits = ~q["point"].to_numpy(zero_copy_only=False)
        count, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        m = len(p)
        for i, j in range_links(_matrix(p["v"]), _matrix(q["v"]), threshold, recall):
            # A pair of points is found from both sides; the query of greater content counts it.
            later = (h[m + i] > h[j]) | ((h[m + i] == h[j]) & (c[m + i] > c[j]))
            keep = visits[i] | later
            i, j = i[keep], j[keep]
            use = wanted(m + i, j)
            a, b = at[m + i[use]], at[j[use]]
            np.add.at(count, a, weight[b])
            np.add.at(count, b, weight[a])
            own = np.flatnonzero(root != np.arange(len(ids)))
            root = _least(len(ids), np.concatenate([a, own]), np.concatenate([b, root[own]]))
        some = np.flatnonzero(count)
        return pa.table({"c": ids[some], "n": count[some], "to": ids[root[some]]})

    found = staged(tasks.groupBy("key", "pa", "qb").applyInArrow(link, "c long, n long, to long"))
    links = found.groupBy("c").agg(F.sum("n").alias("n"))
    joined = components(found.where("c <> to").select(F.col("c").alias("src"), F.col("to").alias("dst")))
    group = same.select("label", "v", "c", "w", "least").join(joined.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = group.groupBy("component").agg(F.min("least").alias("component_id"))
    named = group.join(least, "component").join(links, "c", "left").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    linked = rows.where("ok").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audit(vectors: DataFrame, result: DataFrame, threshold: float = 0.98, block: int = 2048) -> float:
    """Recall of n_links against brute force: queries are rows whose id is divisible by 20, held against all, in blocks.

    result must have one row for each vec_id.
    """
    rows, _ = classes(vectors)
    ok = staged(rows.where("ok").select("vec_id", F.concat_ws(":", F.size("v"), F.col("label").cast("string")).alias("g"), "v"))
    spark = vectors.sparkSession
    prepare(spark)
    asked = ok.where("vec_id % 20 = 0")
    blocks = max(1, -(-asked.count() // block))
    asked = staged(asked.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))))
    wanted = got = 0
    for k in range(blocks):
        by: dict = {}
        for r in asked.where(F.col("b") == k).collect():
            by.setdefault(r.g, []).append(r)
        shared = spark.sparkContext.broadcast({g: (np.array([r.vec_id for r in rs]), np.array([np.array(r.v, float) / np.linalg.norm(np.array(r.v, float)) for r in rs])) for g, rs in by.items()})

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            for b in batches:
                out: dict = {}
                for vec, g, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    known = shared.value.get(g)
                    if known is not None:
                        x = np.asarray(v.values, float)
                        for i in known[0][known[1] @ (x / np.linalg.norm(x)) >= threshold].tolist():
                            if i != vec:
                                out[i] = out.get(i, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], ["vec_id", "n"])

        true = ok.mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
        r = true.join(result, "vec_id").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
        wanted, got = wanted + (r[0] or 0), got + (r[1] or 0)
        shared.unpersist()
    return got / wanted if wanted else 1.0
