import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftpath.llm import langid, quality, toxicity
from driftpath.llm.common import fold

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def more(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_fold(spark):
    rows = spark.range(200).select("id", fold("id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def held(result, labels, label):
    rows = [r for r in result.join(labels, "doc_id").collect() if r.held_out]
    assert len(rows) > 50
    return np.mean([r.predicted == r[label] for r in rows])


def test_quality_held_out(more):
    docs, labels = more
    out = quality.classify(docs, labels)
    assert out.count() == docs.count() and out.where("score < 0 or score > 1").count() == 0
    assert held(out, labels, "quality") > 0.95


def test_toxicity_held_out(more):
    docs, labels = more
    out = toxicity.classify(docs, labels)
    assert out.count() == docs.count() and out.where("score < 0 or score > 1").count() == 0
    assert held(out, labels, "toxic") > 0.9


def test_language_held_out(more):
    docs, _ = more
    rows = langid.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_odd_rows(spark, odd, nothing, more):
    labels = more[1]
    for f in (lambda d: quality.classify(d, labels), lambda d: toxicity.classify(d, labels), langid.identify):
        rows = f(odd).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert f(nothing).count() == 0
    none = labels.limit(0)
    assert {r.score for r in quality.classify(odd, none).collect()} == {0.5}
    assert toxicity.classify(odd, none).where("predicted = 1").count() == 0
    und = {r.doc_id for r in langid.identify(odd).where("lang_pred = 'und'").collect()}
    assert {1, 2, 3} <= und
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_brute_force():
    rng = np.random.default_rng(1)
    terms = ["idiot", "moron", "worthless", "scum", "abc*", "trash", "disgusting"]
    auto = toxicity.Automaton(terms)
    words = set(terms)
    for _ in range(3000):
        w = list(rng.choice(terms).rstrip("*"))
        for _ in range(rng.integers(0, 4)):
            at, kind = rng.integers(0, len(w) + 1), rng.integers(0, 3)
            w[at : at + (kind > 0)] = [] if kind == 1 else [str(rng.choice(list("abcdeiorstx")))]
        words.add("".join(w) + "xyz" * int(rng.integers(0, 2)))
    words = [w for w in words if w]
    found = auto.match(words)
    for w in words:
        near = [(0, t) for t in terms if t[-1] == "*" and w.startswith(t[:-1])]
        near += [(d, t) for t in terms if t[-1] != "*" and (d := edit_distance(w, t)) <= toxicity.edits_of(t)]
        assert (w in found) == bool(near), w
        if near:
            assert found[w][1] == min(near)[0]


def test_quotation_and_misspelling():
    m = toxicity.Model(toxicity.Automaton(list(toxicity.LEXICON)), toxicity.PRIOR, frozenset())
    plain, slip, leet, quoted, clean = m.score(["you are an idiot", "you are an idiott", "you 1d10t", 'he said the word "idiot" was used', "a clean text"])
    assert plain > 0.5 and slip > 0.3 and leet > 0.3 and quoted < 0.3 and clean < 0.3 and plain > quoted


def test_words_of_any_length():
    """Long words are matched: behind punctuation, by a stem, and as long terms; automata share one numbering."""
    long = "z" * 30 + "q" * 70
    lex = toxicity.Lexicon([*toxicity.LEXICON, "grump*", long], part=8)
    assert len(lex.automata) > 5 and sorted(lex.terms) == lex.terms
    words = ["idiot", "idiott", "grump" + "y" * 200, long, long[:-1], "x" * 500, "clean"]
    found = {w: (lex.terms[k], e) for w, (k, e) in lex.match(words).items()}
    assert found == {"idiot": ("idiot", 0), "idiott": ("idiot", 1), words[2]: ("grump*", 0), long: (long, 0), long[:-1]: (long, 1)}
    whole = toxicity.Automaton(lex.terms)
    assert {w: e for w, (_, e) in whole.match(words).items()} == {w: e for w, (_, e) in lex.match(words).items()}
    m = toxicity.Model(lex, toxicity.PRIOR, frozenset())
    a, b, c = m.score(["you idiot" + "!" * 90, "you idiot", "you" + "!" * 90])
    assert a == b > 0.5 > c


def test_labels_with_gaps(spark):
    """Null and repeated rows of labels, labels of unknown documents and other values; the scores stay defined."""
    docs = spark.createDataFrame([(i, f"you idiot number {i}" if i % 2 else f"a calm text of number {i}") for i in range(60)], "doc_id long, text string")
    rows = [(i, i % 2, i % 2) for i in range(60)] + [(3, 1, 1), (3, 1, 1), (None, 1, 0), (5, None, None), (900, 1, 1), (7, 2, 5)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for f in (toxicity.classify, quality.classify):
        out = f(docs, labels).collect()
        assert sorted(r.doc_id for r in out) == list(range(60)) and all(0 <= r.score <= 1 for r in out)
        assert f(docs, labels.limit(0)).count() == 60


def test_ridge_is_the_direct_solution(spark):
    """Summed normal equations give the weights of a ridge over all rows; the features' products near the kernel."""
    docs = spark.createDataFrame([(i, " ".join(["word" * (i % 7 + 1)] * (i % 13 + 1)) + "." * (i % 5)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 > 3), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    m = quality.train(docs, labels, ridges=(0.1,))
    from driftpath.llm.common import held_out

    own = docs.where(~held_out("doc_id")).join(labels, "doc_id").collect()
    stats = np.array([quality.statistics(r.text) for r in own])
    z, y = m.features(stats), np.array([r.quality for r in own], float)
    dual = z.T @ np.linalg.solve(z @ z.T + 0.1 * np.eye(len(z)), y)
    assert np.allclose(z @ m.weights, z @ dual, atol=1e-6)
    x = np.clip((stats - m.mean) / m.scale, -6, 6)[:80]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * x.shape[1]))
    rng = np.random.default_rng(0)
    wide = quality.Model(m.mean, m.scale, rng.normal(size=(x.shape[1], 20_000)) / np.sqrt(x.shape[1]), rng.uniform(0, 2 * np.pi, 20_000), None, None, None)
    f = wide.features(stats[:80])[:, :-1]
    assert np.abs(f @ f.T - exact).max() < 0.05
    f = z[:80, :-1]
    assert np.abs(f @ f.T - exact).mean() < 0.1


def test_bit_sliced_filters():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (5000, 300, 40)]
    f = langid.Filters(["a", "b", "c"], keys)
    for k, h in enumerate(keys):
        assert ((f.masks(h)[:, 0] >> np.uint64(k)) & np.uint64(1)).all()
    other = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)
    rate = [np.mean((f.masks(other)[:, 0] >> np.uint64(k)) & np.uint64(1)) for k in range(3)]
    assert np.allclose(rate, f.false, atol=0.01)
    many = langid.Filters([str(i) for i in range(70)], [keys[2]] * 70)
    assert many.slots.shape[1] == 2 and many.decide("no such text") == ("0", 0.0)


def test_isotonic_is_the_least_squares_fit():
    x, y = np.array([1, 2, 3, 4, 5, 5.0]), np.array([0, 1, 0, 1, 1, 0])
    knots, values = quality.isotonic(x, y)
    assert np.allclose(np.interp([1, 2, 3, 4, 5], knots, values), [0, 0.5, 0.5, 2 / 3, 2 / 3])
