import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from driftpath.llm import linededup, pii

SF = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or "", re.ASCII):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check_spans(rows, texts):
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in PLAIN]
        assert set(want) <= set(r.spans.split(","))


def test_base_spans_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_spans(pii.report(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_base_spans_on_hard_texts(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "_d@e.f", "1.2.3.4", ".5", "256.1.1.1", "+1 (017) 555-7713", "4111 1111 1111 1111", "4111-1111-1111-1111", "é", "日", "\U0001f600", " ", "..", "@", "+", "-", "0", "00012", "x@y", "%+", "\n", '"', "token = \"", "007.000.01.255"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    texts += ["9" * 30_000, "1 " * 20_000, "a" * 50_000 + "@b.co", "a.b-" * 10_000, "x@" + "y." * 8_000 + "z", "+" + "1 " * 9_000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_spans(pii.report(df).collect(), dict(enumerate(texts)))


def test_added_spans_do_not_overlap(spark):
    texts = ['mail: joe (at) site (dot) org now, token = "a81f93b2c4d5e6f7a8b9c0d1"', "call (212) 555-0199 or +1 212 555 0199", "none"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert "secret:" in rows[0] and rows[2] == ""
    for s in rows.values():
        spans = [tuple(map(int, x.split(":")[1:])) for x in s.split(",") if x]
        assert all(a[1] <= b[0] or b[1] <= a[0] for k, a in enumerate(spans) for b in spans[:k])


def test_em_finds_the_better_labeler():
    rng = random.Random(1)
    counts: dict = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = tuple((1 if y else -1) if rng.random() < q else rng.choice((0, -1 if y else 1)) for q in (0.95, 0.8, 0.6, 0.75))
        counts[votes] = counts.get(votes, 0) + 1
    prior, table = pii.reliabilities([(v, float(n)) for v, n in counts.items()])
    assert abs(prior - 0.4) < 0.08 and table[0][1][0] > table[1][1][0] > table[2][1][0]


def test_odd_rows(odd, nothing):
    for f in (pii.report, linededup.report):
        assert f(odd).count() == odd.count()
        assert f(nothing).count() == 0
    kept = {r.doc_id: r.text for r in linededup.report(odd).collect() if r.doc_id not in (7, None)}
    assert kept[1] is None and kept[2] == "" and kept[3] == "   \n\t "
    assert set(linededup.dedup_lines(odd).columns) == {*odd.columns, "_dp_removed"}


def oracle(df):
    db = duckdb.connect()
    documents = df.toPandas()  # noqa: F841  found by name
    return sorted(db.sql(f"SELECT doc_id, text, n_removed, removed FROM ({linededup.SQL})").fetchall())


def test_lines_against_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, linededup.report(docs).select("doc_id", "text", "n_removed", "removed").collect()))
    assert got == oracle(docs)


def test_lines_on_dense_repeats(spark):
    """Short alphabets of lines make runs that overlap, nest and repeat in themselves."""
    rng = random.Random(7)
    lines = ["", "w " * 10, "v " * 17, "u " * 26, "t " * 55, "s", "r q"]
    rows = [(k, "\n".join(x.strip() for x in rng.choices(lines, weights=[1, 6, 6, 4, 1, 3, 3], k=rng.randint(0, 30)))) for k in range(80)]
    rows.append((80, "\n".join(["same two"] * 200)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, linededup.report(df).select("doc_id", "text", "n_removed", "removed").collect()))
    assert got == oracle(df)
    assert got[80][1].count("\n") == 0 or got[80][2] >= 190


def test_first_of_each_group_across_partitions(spark):
    """A group larger than a partition: all its rows but one."""
    rows = [(1 if i % 3 else i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, o long")
    from driftpath.llm.common import staged

    out = sorted((r.g, r.o) for r in linededup._not_first(staged(df.repartition(7)), ["g"], ["o"]).collect())
    first: dict = {}
    for g, o in rows:
        first[g] = min(o, first.get(g, o))
    assert out == sorted((g, o) for g, o in rows if o != first[g])
