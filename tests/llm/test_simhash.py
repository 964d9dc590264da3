import random

import numpy as np
import xxhash

from driftpath.llm import simhash


def slow_print(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(prints, distance=4):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_against_brute_force(docs):
    prints = {r.doc_id: slow_print(r.text) for r in docs.collect()}
    want = slow_components(prints)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_odd_rows(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == "0" * 16 and by[3].component_id == 1 and by[7].component_id == 6
    assert by[4].fingerprint == f"{xxhash.xxh64_intdigest(b'one', 42):016x}"
    assert simhash.near_duplicates(nothing).count() == 0


def test_large_groups_and_chains(spark):
    """A third of all fingerprints near one, chains of small steps, shards cut into chunks; also radius 1."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {}
    for i in range(400):
        x = centre
        for b in rng.sample(range(64), rng.randint(0, 3)):
            x ^= 1 << b
        prints[i] = x
    x = rng.getrandbits(64)
    for i in range(400, 500):
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
        prints[i] = x
    for i in range(500, 1000):
        prints[i] = rng.getrandbits(64)
    want = slow_components(prints)
    rows = [(i, int(np.uint64(x).view(np.int64))) for i, x in prints.items()]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    for kw in ({}, {"shard_cap": 64}, {"blocks": 3, "shard_cap": 200, "depth": 2}, {"blocks": 2, "depth": 1}, {"blocks": 5, "depth": 4}):
        from driftpath.llm.common import components

        found = {r.node: r.component for r in components(simhash.links(df, 4, **kw)).collect()}
        groups: dict = {}
        for i, p in rows:
            groups.setdefault(found.get(p, p), []).append(i)
        got = {i: min(g) for g in groups.values() for i in g}
        assert got == want


def test_visits_are_the_shards_of_the_ball():
    """Each pair within the radius meets once: in one shard, or where the lesser path visits the greater."""
    rng = random.Random(11)
    mask, points = (1 << 12) - 1, simhash._vantages(0, 3, 7)
    fp = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    for radius in (0, 1, 2):
        own = simhash._paths(fp, mask, points)
        rows, paths = simhash._visits(fp, mask, points, radius)
        visits = set(zip(rows.tolist(), paths.tolist(), strict=True))
        assert len(visits) == len(rows) and all(p > own[r] for r, p in visits)
        for i in range(300):
            for j in range(i):
                if bin((int(fp[i]) ^ int(fp[j])) & mask).count("1") <= radius:
                    assert (own[i] == own[j]) + ((i, own[j]) in visits) + ((j, own[i]) in visits) == 1
        got = [(p, q) for a, b in simhash._split(fp, fp, mask, radius, 100) for p in a.tolist() for q in b.tolist()]
        assert radius > 1 or len(got) < 300 * 300  # the bound leaves branches out
        near = {(i, j) for i in range(300) for j in range(300) if bin((int(fp[i]) ^ int(fp[j])) & mask).count("1") <= radius}
        assert near <= set(got) and len(set(got)) == len(got)
    assert simhash._radii(4, 3) == [1, 1, 0] and simhash._radii(3, 2) == [1, 1] and simhash._radii(2, 1) == [2]


def test_rows_of_one_id(spark):
    """Rows that share an id but not a group all stay; repeated rows of one group leave one."""
    rows = [(7, "alpha beta gamma delta epsilon zeta"), (7, "one two three four five six"), (7, "one two three four five six"), (3, "red orange yellow green blue black"), (9, "red orange yellow green blue black"), (None, "no id here and none there"), (None, "no id here and none there")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from driftpath.llm import shingledup

    want = sorted([rows[0], rows[1], rows[3], rows[5]], key=str)
    assert sorted((tuple(r) for r in simhash.one_of_each(df).collect()), key=str) == want
    assert sorted((tuple(r) for r in shingledup.one_of_each(df).collect()), key=str) == want
