"""Quality scores: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics of the text. Each partition sums its outer
products; the sums (a fixed size) meet on the driver, by part of four, so that every part is also scored by weights
that did not see it; those scores and their labels give the isotonic map to a probability.

Learned from a bounded sample: about `sample_docs` labelled rows outside the held-out fold (by hash of doc_id).

Null and empty texts have the statistics of an empty text and a score like any other. A null doc_id is in no held-out
fold; repeated rows are each scored; an empty table gives no rows. Without labels of both kinds every score is the
share of ones, or 0.5 without any.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled, per_text, staged

PARTS = 4


def statistics(text: str | None) -> list[float]:
    """About length, words, letters, symbols, repetition and lines; finite for any text."""
    text = text or ""
    n = max(len(text), 1)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    by = np.bincount(np.minimum(code, 0x250), minlength=0x251)
    p = by[by > 0] / n
    words = text.split()
    nw = max(len(words), 1)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    lines = text.split("\n")
    plain = by[48:58].sum() + by[65:91].sum() + by[97:123].sum() + by[0xC0:].sum() + by[9:14].sum() + by[32] + by[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    return [
        np.log1p(len(words)), np.log1p(len(text)), lengths.mean(), np.log1p(lengths.std()), by[65:91].sum() / n, by[97:123].sum() / n,
        by[48:58].sum() / n, by[0xC0:].sum() / n, (by[44] + by[46]) / nw, by[33] / nw, by[124] / nw, 1 - plain / n,
        len(counts) / nw, np.log1p(nw) - np.log1p(len(counts)), max(counts.values(), default=0) / nw,
        sum(map(eq, words, words[1:])) / nw, 1 - len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(nw / len(lines)),
        -(p * np.log(p)).sum() if len(p) else 0.0,
    ]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and values of the non-decreasing map nearest to y."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order].astype(float)
    first = np.flatnonzero(np.diff(x, prepend=-np.inf) > 0)
    sums, sizes = np.add.reduceat(y, first), np.diff(np.append(first, len(x))).astype(float)
    at, blocks = x[first], []
    for a, s, n in zip(at, sums, sizes, strict=True):
        blocks.append([s, n, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, _, hi = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += n2
            blocks[-1][3] = hi
    knots = np.array([z for b in blocks for z in (b[2], b[3])])
    values = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return knots, values


class Model:
    def __init__(self, mean, scale, waves, phase, weights, knots, values) -> None:
        self.mean, self.scale, self.waves, self.phase, self.weights, self.knots, self.values = mean, scale, waves, phase, weights, knots, values

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / self.waves.shape[1]) * np.cos(z @ self.waves + self.phase), np.ones((len(z), 1))])

    def score(self, texts: list) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.values)
        raw = self.features(np.array([statistics(x) for x in texts]).reshape(-1, len(self.mean))) @ self.weights
        return np.clip(np.interp(raw, self.knots, self.values), 0, 1)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_docs: int = 20_000, waves: int = 256, ridges: tuple = (1e-3, 1e-2, 1e-1, 1.0), seed: int = 11) -> Model:
    def stats(texts: list) -> list:
        import pyarrow as pa

        return [pa.array([list(map(float, statistics(x))) for x in texts], pa.list_(pa.float64()))]

    rows = staged(per_text(labelled(docs, labels, label, sample_docs), stats, "_dp_x array<double>").drop("text"))
    d = len(statistics(""))
    sums = rows.agg(
        F.count(F.lit(1)), F.sum("_dp_y"), *[F.avg(F.col("_dp_x")[i]) for i in range(d)], *[F.stddev_pop(F.col("_dp_x")[i]) for i in range(d)]
    ).first()
    if not sums[0] or sums[1] in (0, sums[0]):
        return Model(None, None, None, None, None, None, sums[1] / sums[0] if sums[0] else 0.5)
    rng = np.random.default_rng(seed)
    mean, scale = np.array(sums[2 : 2 + d]), np.maximum(np.array(sums[2 + d :]), 1e-6)
    m = Model(mean, scale, rng.normal(size=(d, waves)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, waves), np.zeros(1), None, None)

    def outer(batches: Iterator) -> Iterator:
        import pyarrow as pa

        a, c = np.zeros((PARTS, waves + 1, waves + 1)), np.zeros((PARTS, waves + 1))
        for b in batches:
            y, part = np.asarray(b.column(0)), np.asarray(b.column(1))
            z = m.features(np.array(b.column(2).to_pylist()).reshape(-1, d))
            for k in range(PARTS):
                a[k] += z[part == k].T @ z[part == k]
                c[k] += z[part == k].T @ y[part == k]
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], ["a", "c"])

    few = rows.select("_dp_y", "_dp_part", "_dp_x").coalesce(8)
    a, c = np.zeros((PARTS, waves + 1, waves + 1)), np.zeros((PARTS, waves + 1))
    for r in few.mapInArrow(outer, "a binary, c binary").toLocalIterator():
        a += np.frombuffer(r.a).reshape(a.shape)
        c += np.frombuffer(r.c).reshape(c.shape)
    solve = lambda a, c, r: np.linalg.solve(a + r * np.eye(len(a)), c)
    each = np.array([[solve(a.sum(0) - a[k], c.sum(0) - c[k], r) for k in range(PARTS)] for r in ridges])

    def apart(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            z = m.features(np.array(b.column(2).to_pylist()).reshape(-1, d))
            s = np.einsum("nd,rnd->rn", z, each[:, np.asarray(b.column(1))])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x) for x in s]], ["y", *[f"s{i}" for i in range(len(ridges))]])

    seen = few.mapInArrow(apart, "y int, " + ", ".join(f"s{i} double" for i in range(len(ridges)))).toPandas()
    y = seen["y"].to_numpy()
    best = min(range(len(ridges)), key=lambda i: float(((seen[f"s{i}"] - y) ** 2).mean()))
    m.weights = solve(a.sum(0), c.sum(0), ridges[best])
    m.knots, m.values = isotonic(seen[f"s{best}"].to_numpy(), y)
    return m


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _dp_score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list:
        import pyarrow as pa

        return [pa.array(shared.value.score(texts), pa.float64())]

    return per_text(docs, run, "_dp_score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **kw) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs, labels, **kw))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_dp_score").alias("score"), (F.col("_dp_score") >= threshold).cast("int").alias("predicted"))
