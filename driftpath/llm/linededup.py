"""Line dedup: a suffix array over line-id sequences by prefix doubling, in DataFrame operations alone.

A document is the sequence of its lines. A run of lines with at least `min_words` words that also stands earlier, by
(doc_id, place), is a later copy, and all its lines go; the first copy stays. Copies may overlap (a line written 100
times in a row is a run that repeats itself one line on).

Ranks. Only lines that occur twice take part. rank_0 orders them by line id (128 bits of hash); rank_(k+1) orders
pairs (rank_k at p, rank_k at p + 2^k), of which again only those that occur twice stay. A rank is the place of a
suffix, as far as 2^k lines tell, in the suffix array: a range-partitioned sort of the distinct pairs numbers them in
order, and no group of equal suffixes meets in one task. Doubling ends at the longest run that is asked about.

Intervals. A longest-common-prefix interval of depth n holds the suffixes that share n lines; its members are those of
one pair (rank_k at p, rank_k at p + n - 2^k), 2^k <= n < 2^(k+1). Every repeated run is the union of the least runs of
`min_words` words that begin or end at one of its lines, so intervals at these depths tell all lines of all maximal
repeated runs, and the least place of an interval is its first copy.

Null and empty texts stay as they are. A null doc_id counts as the least. Rows of equal doc_id and text are one
document written twice: they fare alike. With ties in doc_id the order is by a hash of the text. An empty table gives
no rows. Other columns pass through; internal columns begin with _dp_.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

_WHITE = r"[^\x20\x09-\x0D]+"
_KEY = ("_dp_d", "_dp_t")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_dp_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("_dp_t", F.coalesce(F.xxhash64("text"), F.lit(0)))


def _lines(docs: DataFrame) -> DataFrame:
    """_dp_d, _dp_t, pos, a, b (the line's id), w (its words)."""
    keyed = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).where("text is not null")
    line = F.col("line")
    return keyed.select(*_KEY, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select(
        *_KEY, "pos", F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"), F.regexp_count(line, F.lit(_WHITE)).cast("long").alias("w")
    )


def _ranked(classes: DataFrame, *by: str) -> DataFrame:
    """Distinct rows numbered in their order: ascending, not dense."""
    return staged(classes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("r", F.monotonically_increasing_id()))


def suffix_ranks(docs: DataFrame, min_words: int = 50) -> tuple[DataFrame, DataFrame]:
    """(active, ranks): lines that occur twice with their runs; and (_dp_d, _dp_t, pos, k, r) for each level k."""
    lines = staged(_lines(docs))
    doubled = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ids = _ranked(doubled, "a", "b")
    w = Window.partitionBy(*_KEY).orderBy("pos")
    level = lines.join(ids, ["a", "b"]).select(*_KEY, "pos", "w", "r").dropDuplicates([*_KEY, "pos"])
    run = level.withColumn("run", F.col("pos") - F.row_number().over(w))
    in_run = Window.partitionBy(*_KEY, "run")
    upto = F.sum("w").over(in_run.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    active = run.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("w")).withColumns({
        "last": F.max("pos").over(in_run), "all_words": F.max("upto").over(in_run), "first": F.min("pos").over(in_run),
    })
    ahead = F.min("pos").over(in_run.orderBy(F.desc("before")).rangeBetween(Window.unboundedPreceding, -min_words)) - 1
    behind = F.max("pos").over(in_run.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words)) + 1
    active = active.where(F.col("all_words") >= min_words).withColumn(
        "stop", F.coalesce(ahead, F.when(F.col("all_words") - F.col("before") >= min_words, F.col("last")))
    ).withColumn("begin", F.coalesce(behind, F.when(F.col("upto") >= min_words, F.col("first"))))
    active = staged(active.select(*_KEY, "pos", "r", "stop", "begin"))
    longest = active.agg(F.max(F.greatest(F.col("stop") - F.col("pos"), F.col("pos") - F.col("begin")) + 1)).first()[0] or 0
    level = active.select(*_KEY, "pos", "r")
    levels = [level.withColumn("k", F.lit(0))]
    for k in range(1, max(1, int(longest)).bit_length()):
        step = 1 << (k - 1)
        far = F.first("r").over(w.rangeBetween(step, step))
        pairs = staged(level.withColumn("r2", far).where("r2 is not null").withColumnRenamed("r", "r1"))
        twice = pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        level = staged(pairs.join(_ranked(twice, "r1", "r2"), ["r1", "r2"]).select(*_KEY, "pos", "r"))
        levels.append(level.withColumn("k", F.lit(k)))
    ranks = levels[0]
    for x in levels[1:]:
        ranks = ranks.unionByName(x)
    return active, ranks


def _not_first(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Those rows (distinct by group and order) that are not the first of their group, with no group met in one task.

    Rows are dealt by range over group and order, so a large group spans tasks; sorted rows are numbered, and a row is
    compared with that of the number before. The heads of partitions are compared with the tails, one row of each.
    """
    names = [*group, *order]
    dealt = rows.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("_dp_i", F.monotonically_increasing_id())
    dealt = staged(dealt.withColumn("_dp_p", F.shiftright("_dp_i", 33)))
    key = F.struct(*group)
    before = dealt.select((F.col("_dp_i") + 1).alias("_dp_i"), key.alias("_dp_before"))
    inner = dealt.join(before, "_dp_i").where(F.col("_dp_before") == key)
    ends = dealt.groupBy("_dp_p").agg(F.min("_dp_i").alias("_dp_i"), F.min_by(key, "_dp_i").alias("head"), F.max_by(key, "_dp_i").alias("tail"))
    joined = ends.withColumn("last", F.lag("tail").over(Window.orderBy("_dp_p"))).where(F.col("head") == F.col("last")).select("_dp_i")
    return inner.select(*rows.columns).unionByName(dealt.join(F.broadcast(joined), "_dp_i").select(*rows.columns))


def later_copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """_dp_d, _dp_t, s, e: disjoint ranges of lines that are later copies, in no order."""
    active, ranks = suffix_ranks(docs, min_words)
    both = active.where("stop is not null").select(*_KEY, F.col("pos").alias("s"), F.col("stop").alias("e")).union(
        active.where("begin is not null").select(*_KEY, F.col("begin").alias("s"), F.col("pos").alias("e"))
    ).distinct()
    n = (F.col("e") - F.col("s") + 1).cast("int")
    windows = both.withColumn("n", n).withColumn("k", (F.length(F.bin(F.col("n"))) - 1).cast("int"))
    windows = windows.withColumn("s2", F.col("e") + 1 - F.expr("shiftleft(1, k)"))
    ends = ranks.select(*_KEY, F.col("pos").alias("s2"), "k", F.col("r").alias("r2"))
    named = staged(windows.join(ranks.withColumnRenamed("pos", "s"), [*_KEY, "s", "k"]).join(ends, [*_KEY, "s2", "k"]).select(*_KEY, "s", "e", "n", "r", "r2"))
    gone = _not_first(named, ["n", "r", "r2"], [*_KEY, "s"]).select(*_KEY, "s", "e")
    by = Window.partitionBy(*_KEY).orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    isle = gone.withColumn("new", F.when(F.col("s") <= reach + 1, 0).otherwise(1)).withColumn("isle", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return isle.groupBy(*_KEY, "isle").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("isle")


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with later copies gone from text, and _dp_removed, the ranges of lines taken out (array of s, e; from 0)."""
    ranges = staged(later_copies(docs, min_words)).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_dp_removed"))
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.exists("_dp_removed", lambda x: (x.s <= i) & (i <= x.e)))
    # Merged whatever the size: ranges grow with the documents, so they are never broadcast.
    out = _keyed(docs).join(ranges.hint("merge"), list(_KEY), "left").withColumn("text", F.when(F.col("_dp_removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return out.select(*docs.columns, F.coalesce("_dp_removed", F.array().cast("array<struct<s:int,e:int>>")).alias("_dp_removed"))


def report(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, text, n_removed (lines), removed (their ranges, s-e joined by commas)."""
    out = dedup_lines(docs.select("doc_id", F.col("text").cast("string").alias("text")), min_words)
    return out.select(
        "doc_id", "text", F.aggregate("_dp_removed", F.lit(0).cast("long"), lambda n, x: n + x.e - x.s + 1).alias("n_removed"),
        F.array_join(F.transform("_dp_removed", lambda x: F.concat_ws("-", x.s, x.e)), ",").alias("removed"),
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos - 1 AS pos, a[pos] AS line, a FROM (
    SELECT doc_id, a, unnest(generate_series(1, len(a))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))
), words AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM lines
), sums AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM words
), runs AS (
  SELECT p.doc_id, p.pos AS s, (SELECT min(q.pos) FROM sums q WHERE q.doc_id = p.doc_id AND q.pos >= p.pos AND q.upto - p.upto + p.w >= 50) AS e, p.a FROM sums p
  UNION
  SELECT q.doc_id, (SELECT max(p.pos) FROM sums p WHERE p.doc_id = q.doc_id AND p.pos <= q.pos AND q.upto - p.upto + p.w >= 50) AS s, q.pos AS e, q.a FROM sums q
), held AS (
  SELECT doc_id, s, e, array_to_string(a[s + 1:e + 1], chr(10)) AS body FROM runs WHERE s IS NOT NULL AND e IS NOT NULL
), copies AS (
  SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS n FROM held) WHERE n > 1
), gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN copies c ON l.doc_id = c.doc_id AND l.pos BETWEEN c.s AND c.e
), isles AS (
  SELECT doc_id, min(pos) AS s, max(pos) AS e FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS isle FROM gone) GROUP BY doc_id, isle
), ranges AS (
  SELECT doc_id, string_agg(s || '-' || e, ',' ORDER BY s) AS removed, CAST(sum(e - s + 1) AS BIGINT) AS n_removed FROM isles GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.removed, '') AS removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN ranges r ON d.doc_id = r.doc_id
"""
