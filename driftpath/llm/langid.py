"""Language identification by n-gram filters whose slots are bitmasks of languages.

Each language has a Bloom filter of the character n-grams it is known by; the filters are stored bit-sliced, so a slot
of the one array is a mask of the languages that have this bit set, and the AND of an n-gram's slots is the set of all
languages that hold it. For a text the masks' bits are counted by language, each count is corrected for the false
positives that the fill of its filter predicts, and the largest corrected share decides.

An n-gram belongs to a language whose relative frequency of it is at least `share` of the largest one, if it was seen
`least` times. Learned from a bounded sample: about `sample_docs` documents of each language (by hash of doc_id).

A null text and one without letters are `und` with score 0. A null doc_id is in no held-out fold; repeated rows are
each predicted; an empty table gives no rows. With nothing to learn from, all is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, per_text, prepare, staged, thinned

SIZES = (2, 3, 4)
#: One odd multiplier for each hash function.
_SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
HASHES = len(_SPREAD)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngrams(text: str | None) -> np.ndarray:
    """Hashes of the text's n-grams, in lower case, words set off by blanks; none if it has no letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[code]
    if not letter.any():
        return np.empty(0, np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    code = np.concatenate([[np.uint64(32)], code, [np.uint64(32)]])
    out = []
    with np.errstate(over="ignore"):
        for n in SIZES:
            if len(code) >= n:
                h = np.full(len(code) - n + 1, n, np.uint64)
                for k in range(n):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : len(code) - n + 1 + k]
                h ^= h >> np.uint64(29)
                out.append(h * np.uint64(0xBF58476D1CE4E5B9))
    return np.concatenate(out)


class Filters:
    """The bit-sliced filters: slots[m, words] of masks, and by language the rate of false positives."""

    def __init__(self, langs: list[str], by_lang: list[np.ndarray]) -> None:
        self.langs = langs
        most = max([1, *map(len, by_lang)])
        self.bits = max(12, int(np.ceil(np.log2(most * HASHES * 4))))
        self.slots = np.zeros((1 << self.bits, -(-len(langs) // 64) or 1), np.uint64)
        fill = []
        for k, keys in enumerate(by_lang):
            for at in self.places(keys):
                self.slots[at, k // 64] |= np.uint64(1 << (k % 64))
            fill.append(float(((self.slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()))
        self.false = np.asarray(fill) ** HASHES

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            h = h ^ (h >> np.uint64(32))
            return [((h * np.uint64(c)) >> np.uint64(64 - self.bits)).astype(np.int64) for c in _SPREAD]

    def masks(self, h: np.ndarray) -> np.ndarray:
        a, *rest = self.places(h)
        m = self.slots[a]
        for b in rest:
            m &= self.slots[b]
        return m

    def decide(self, text: str | None) -> tuple[str, float]:
        h = ngrams(text)
        if not len(h) or not self.langs:
            return "und", 0.0
        m = self.masks(h)
        hits = np.array([np.count_nonzero((m[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)) for k in range(len(self.langs))])
        share = np.clip((hits / len(h) - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)
        best = int(share.argmax())
        second = float(np.delete(share, best).max()) if len(share) > 1 else 0.0
        return self.langs[best], float(share[best] / (share[best] + second)) if share[best] > 0 else 0.0


def train(docs: DataFrame, sample_docs: int = 1500, share: float = 0.25, least: int = 3) -> Filters:
    prepare(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")
    )
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = thinned(known, sizes, "lang", sample_docs)
    langs = sorted(sizes)
    code = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            held: dict[int, list] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(code[lang], []).append(ngrams(text))
            for k, hs in held.items():
                u, n = np.unique(np.concatenate(hs), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k, np.int32)), pa.array(u.view(np.int64)), pa.array(n)], ["k", "h", "n"])

    counts = staged(some.select("text", "lang").mapInArrow(count, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")))
    total = {r.k: r.t for r in counts.groupBy("k").agg(F.sum("n").alias("t")).collect()}
    if not total:
        return Filters([], [])
    rate = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for kv in total.items() for x in kv]), F.col("k"))
    seen = counts.groupBy("h").agg(F.collect_list(F.struct("k", rate.alias("r"), "n")).alias("x"))
    kept = seen.select("h", F.explode(F.filter("x", lambda y: (y.n >= least) & (y.r >= share * F.array_max(F.transform("x", lambda z: z.r))))).alias("y")).select("h", F.col("y.k").alias("k"))
    found = kept.toArrow()
    h, k = found.column("h").to_numpy().view(np.uint64), found.column("k").to_numpy()
    return Filters(langs, [h[k == i] for i in range(len(langs))])


def predict(docs: DataFrame, model: Filters) -> DataFrame:
    """docs with _dp_lang and _dp_score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list:
        import pyarrow as pa

        found = [shared.value.decide(x) for x in texts]
        return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

    return per_text(docs, run, "_dp_lang string, _dp_score double")


def identify(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    out = predict(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs, **kw))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_dp_lang").alias("lang_pred"), F.col("_dp_score").alias("score"))
