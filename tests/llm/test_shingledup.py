"""Near copies of the pipeline's stage against exact Jaccard over all pairs."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from driftpath.llm import shingledup


def test_edited_copies_go(spark):
    """Copies with a changed word here and there: similar by 0.8 or more, though SimHash tells them apart by over 4 bits."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        rows.append((10 * k, " ".join(words)))
        for j, edits in enumerate((1, 2, 4, 12), 1):
            other = list(words)
            for at in rng.choice(120, edits, replace=False):
                other[at] = "changed"
            rows.append((10 * k + j, " ".join(other)))
    hub = [f"h{x}" for x in range(100)]  # one large group, of more links than one leader has
    for j in range(200):
        other = list(hub)
        for at in rng.choice(100, 2, replace=False):
            other[at] = f"e{j}"
        rows.append((1000 + j, " ".join(other)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == {top(i) for i in ids}
    few = shingledup.one_of_each(docs, least=1.0).count()
    assert few == len({frozenset(s) for s in sets.values()})


def test_simhash_trees_bring_candidates(spark):
    """Classes that share no band are linked if operator 10's search finds their fingerprints and their sets are similar."""
    rows = [(1, [], 0), (2, [], 7), (3, [], 0xFFF), (4, [], 7), (5, [9], 1 << 40), (6, [9], -1)]
    sets = {1: range(10), 2: range(1, 11), 3: range(10), 4: range(50, 60), 5: range(70, 80), 6: range(70, 80)}
    # 1 and 2 differ in 3 bits and are similar; 3 is like 1 but 9 bits from the nearest; 4 has 2's fingerprint and another set; 5 and 6 share a band.
    prints = spark.createDataFrame([(f, [k + 100 for k in keys], sim) for f, keys, sim in rows], "fp long, keys array<long>, sim long")
    prints = prints.withColumn("keys", F.concat("keys", F.array(F.col("fp") + 1000)))
    held = spark.createDataFrame([(f, [int(x) for x in s]) for f, s in sets.items()], "fp long, shingles array<long>")
    got = {tuple(sorted((r.src, r.dst))) for r in shingledup.links(prints, lambda needed: held.join(needed, "fp", "left_semi")).collect()}
    assert got == {(1, 2), (5, 6)}


def test_no_sets_are_kept_of_texts_without_candidates(spark, monkeypatch):
    """Sets are as large as the texts: only those that a candidate pair names are staged."""
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 5000, 300))) for k in range(400)]
    rows += [(1000 + k, text + " more") for k, text in rows[:20]]
    kept = []

    def seen(df, put=shingledup.staged):
        out = put(df)
        if {"shingles", "_dp_set"} & set(out.columns):
            kept.append(out.count())
        return out

    monkeypatch.setattr(shingledup, "staged", seen)
    got = {r.doc_id for r in shingledup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(400))
    assert kept == [40]


def test_sieved(spark):
    from driftpath.llm.common import sieved

    rows = spark.range(-500, 20000).select(F.col("id").alias("doc_id"))
    for ids in (rows.where("doc_id % 7 = 3"), rows.limit(0), spark.range(3, 4).toDF("doc_id")):
        met = {r.doc_id for r in sieved(rows, ids, "doc_id").where("_dp_met").collect()}
        own = {r.doc_id for r in ids.collect()}
        assert own <= met and len(met - own) <= 20500 / 8
    assert sieved(spark.createDataFrame([(None,)], "doc_id long"), spark.range(5).toDF("doc_id"), "doc_id").count() == 1


def test_the_lesser_table_tells_the_rows_that_stay(spark):
    """Few rows stay, or few go."""
    one = [(k, "the same words in each of these many rows") for k in range(300)]
    other = [(1000 + k, f"text number {k} has words of its own {k} {k + 1} {k + 2}") for k in range(30)]
    for rows, want in ((one + other, {0, *range(1000, 1030)}), (one[:3] + other, {0, *range(1000, 1030)}), (other, set(range(1000, 1030)))):
        docs = spark.createDataFrame([(i, t, i % 3) for i, t in rows], "doc_id long, text string, extra long")
        got = shingledup.one_of_each(docs)
        assert got.columns == docs.columns
        assert {r.doc_id for r in got.collect()} == want and got.count() == len(want)
