import numpy as np

import corpus_pipeline
from driftpath.llm import annindex, decontam

SF = "/root/testdata/sf0.001"


def brute(rows, threshold=0.98):
    """n_links and component by id."""
    ok = [(i, lab, np.array(v, float)) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, *_ in rows}
    for a, (i, lab, v) in enumerate(ok):
        for j, lab2, w in ok[:a]:
            if lab == lab2 and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[i].add(j)
                links[j].add(i)
    comp = {}
    for i in sorted(links):
        if i not in comp:
            held, comp[i] = [i], i
            while held:
                for j in links[held.pop()]:
                    if j not in comp:
                        comp[j] = i
                        held.append(j)
    return {i: (len(links[i]), comp[i]) for i in links}


def vectors(spark, n=700, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    centre = rng.normal(size=16)
    for i in range(n):
        v = centre + rng.normal(size=16) * 0.03 if i % 3 == 0 else rng.normal(size=16)
        if i % 10 == 7:
            v = rows[-1][1]
        rows.append((i, [float(x) for x in np.asarray(v, "f4")], int(i % 3 != 0 and i % 2)))
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] + [1.0] * 15, 0), (n + 4, [None] + [1.0] * 15, 0), (n + 5, rows[0][1], None), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_links_against_brute_force(spark):
    rows, df = vectors(spark)
    want = brute(rows)
    for kw in ({}, {"cell": 128, "cell_cap": 96}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in annindex.near_duplicates(df, **kw).collect()}
        assert set(got) == set(want)
        assert sum(min(got[i][0], want[i][0]) for i in want) >= 0.98 * sum(w[0] for w in want.values())
        assert all(got[i][0] <= want[i][0] for i in want)  # none below the threshold
        assert all(got[i][2] == (got[i][1] == i) for i in want)
        assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.99
    assert annindex.audit(df, annindex.near_duplicates(df)) >= 0.95


def test_no_vectors(spark):
    _, df = vectors(spark, 10)
    assert annindex.near_duplicates(df.limit(0)).count() == 0
    assert annindex.near_duplicates(df.where("vec_id >= 10 and vec_id < 15")).where("n_links = 0 and kept").count() == 5


def test_ids_and_columns(spark):
    """Repeated and null ids, and columns of the names used inside."""
    from pyspark.sql import functions as F

    a, b, c = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a, 1), (5, b, 1), (5, c, 1), (None, a, 1), (None, c, 2), (9, b, 2), (7, c, None), (3, c, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumns({k: F.lit("clash") for k in ("key", "v", "c", "h", "w", "own", "point", "least", "component", "ok", "kept")})
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in annindex.near_duplicates(df).collect()), key=str)
    want = [(5, 2, 5, True), (5, 2, 5, True), (5, 0, 5, True), (None, 2, 5, True), (None, 1, 3, True), (9, 0, 9, True), (7, 0, 7, True), (3, 1, 3, True)]
    assert got == sorted(want, key=str)


def test_borders_lose_no_pair():
    """Any two vectors at the threshold share the home of one of them."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8))
    x[1500:] = x[:1500] + rng.normal(size=(1500, 8)) * 0.12
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own, inside = annindex.borders(x, x[rng.choice(3000, 40, replace=False)], float(np.sqrt(2 - 2 * 0.98)))
    i, j = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    assert len(i) > 1000 and (own[i] != own[j]).sum() > 100
    assert (inside[i, own[j]] | inside[j, own[i]]).all() and inside.mean() < 0.5


def test_cells_split_twice(spark):
    """Small cells: two levels and chunks, all links found."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2400, 12))
    x[800:1600] = x[:800] + rng.normal(size=(800, 12)) * 0.04
    rows = [(i, [float(v) for v in u], 1) for i, u in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.98).sum(1) - 1
    got = {r.vec_id: r.n_links for r in annindex.near_duplicates(df, cell=40, cell_cap=60, fan=6).collect()}
    assert all(got[i] <= true[i] for i in got) and sum(got.values()) >= 0.99 * true.sum() > 1000


def test_graph_search_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    x[500:900] = x[:400] + rng.normal(size=(400, 24)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = (np.concatenate(c) for c in zip(*annindex.cell_links(x, None, 0.95, 0.995), strict=True))
    true = (x @ x.T >= 0.95).sum() - len(x)
    assert true > 600 and len(i) >= 0.99 * true and (np.einsum("ij,ij->i", x[i], x[j]) >= 0.95).all()


def slow_tiles(a, b, tile):
    """The textbook's greedy string tiling."""
    fa, fb, out = [True] * len(a), [True] * len(b), 0
    while True:
        most, best = tile - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n > most:
                    most, best = n, [(i, j)]
                elif n == most and n >= tile:
                    best.append((i, j))
        if not best:
            return out
        for i, j in best:
            if all(fa[i : i + most]) and all(fb[j : j + most]):
                fa[i : i + most] = [False] * most
                fb[j : j + most] = [False] * most
                out += most


def test_tiles_against_the_textbook():
    rng = np.random.default_rng(5)
    for _ in range(150):
        a, b = rng.integers(1, 5, rng.integers(0, 18)), rng.integers(1, 5, rng.integers(0, 30))
        assert sum(x[2] for x in decontam.tiles(a, b, 3)) == slow_tiles(a.tolist(), b.tolist(), 3)


def test_planted_passages(spark, odd, nothing):
    items = ["one two three four five six seven eight nine ten", "red orange yellow green blue indigo violet black white grey", None, "", "few words"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = {
        0: "before " + items[0] + " after", 1: "Six seven eight nine ten! And then: ONE two three, four five", 2: "one two three and no more four five", 3: items[1].replace("yellow", "pink"),
        4: "nothing of the kind", 5: "few words", 6: None, 7: "", 8: (items[0] + " x ") * 500,
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for kw in ({}, {"block_words": 5}):
        got = {r.doc_id: r.item_ids for r in decontam.judged(df, bench, **kw).where("contaminated").collect()}
        assert got == {0: [0], 1: [0], 3: [1], 5: [4], 8: [0]}  # an item shorter than a seed matches whole
    assert decontam.judged(odd, bench).count() == odd.count() and decontam.judged(nothing, bench).count() == 0
    assert decontam.judged(df, bench.limit(0)).where("contaminated").count() == 0


def test_dense_tiles_are_the_same():
    rng = np.random.default_rng(8)
    for _ in range(60):
        a, b = rng.integers(1, 3, rng.integers(3, 20)), rng.integers(1, 3, rng.integers(3, 40))
        assert decontam._dense_tiles(a, b, 3) == decontam.tiles(a, b, 3)
    most = decontam.tiles(np.full(400, 1), np.full(20_000, 1), 3)
    assert sum(x[2] for x in most) == 400


def test_short_items_and_many_blocks(spark):
    """Items of 1 to 4 words match whole and in order alone; null and repeated ids; clashing columns; one item a block."""
    from pyspark.sql import functions as F

    items = [(1, "alpha beta gamma delta"), (1, "lonely"), (None, "two words"), (4, "one two three four five six"), (5, "one two three four five six")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({k: F.lit("clash") for k in ("doc_id", "_dp_found", "words", "coverage")})
    texts = {0: "so Alpha beta, gamma delta it is", 1: "alpha beta gamma", 2: "delta gamma beta alpha", 3: "a LONELY one", 4: "words two", 5: "of two words", 6: "one two three four five six"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for kw in ({}, {"block_words": 1}):
        got = {r.doc_id: r.item_ids for r in decontam.judged(df, bench, **kw).where("contaminated").collect()}
        assert got == {0: [1], 3: [1], 5: [None], 6: [4, 5]}


def test_judged_against_slow_tiles(spark):
    """Any benchmark item, any document that shares five words in a row with it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = lambda t: decontam._WORD.findall(t.lower())
    items = {r.item_id: words(r.text) for r in bench.collect()}
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    own = {i: grams(w) for i, w in items.items()}
    want = {}
    for r in docs.collect():
        w = words(r.text)
        have = grams(w)
        hit = [i for i in items if own[i] & have and slow_tiles(items[i], w, 3) >= 0.5 * len(items[i])]
        if hit:
            want[r.doc_id] = hit
    got = {r.doc_id: r.item_ids for r in decontam.judged(docs, bench).where("contaminated").collect()}
    assert got == want and want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        from driftpath.llm.common import staged

        kept = staged(kept)
        counts.append(kept.count())
        assert kept.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()
    assert counts == sorted(counts, reverse=True) and counts[2] == counts[1] and counts[1] > 0.7 * counts[0]
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_pipeline_stages_on_odd_rows(spark, odd, nothing):
    cols = list(corpus_pipeline.COLUMNS)
    for rows in (odd, odd.select(cols), nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            n = out.count()
            assert n <= rows.count() or name == "packing"
            if name != "packing":
                assert out.columns == rows.columns
