"""Helpers shared by the corpus operators: shared-folder tables, held-out folds, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, importable, release, shared_dir, staged, staged_path

__all__ = ["components", "fold", "held_out", "labelled", "per_text", "prepare", "release", "shared_dir", "sieved", "staged", "staged_path", "table", "thinned"]


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep their Arrow batches small."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id's decimal text, modulo 4; null ids fall in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4, F.lit(0)).cast("int")


def held_out(doc_id: Column | str) -> Column:
    return fold(doc_id) == 2


def thinned(df: DataFrame, counts: dict, key: str | None, bound: int, id_col: str = "doc_id") -> DataFrame:
    """A repeatable sample of about `bound` rows (of each value of `key`): rows whose id hashes below bound/count.

    It needs no sort and no group in one task, however frequent a key is.
    """
    spread = 1 << 30
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit("thinned")), F.lit(spread))
    limit = F.lit(spread)
    for value, n in counts.items():
        if n > bound:
            cut = F.lit(int(spread * bound / n))
            limit = cut if key is None else F.when(F.col(key) == F.lit(value), cut).otherwise(limit)
    return df.where(h < limit)


def sieved(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df with _dp_met: true for every row whose key (a long) is in ids, and for up to one other row in eight.

    No row of df is shuffled: the ids are set as bits in a table of 16 MB at most, which is broadcast. An exact join of
    the rows that are met is left to the caller. Beyond 16 million ids more rows are met.
    """
    wide = 1 << 15  # bits of one bitmap
    bits = min(max(1 << (8 * ids.count()).bit_length(), wide), 1 << 27)
    h = F.pmod(F.xxhash64(F.col(key).cast("long"), F.lit("sieve")), F.lit(bits))
    table = ids.select(h.alias("h")).groupBy((F.col("h") / wide).cast("long").alias("_dp_at")).agg(F.bitmap_construct_agg(F.col("h") % wide).alias("_dp_bits"))
    met = df.withColumn("_dp_h", h).withColumn("_dp_at", (F.col("_dp_h") / wide).cast("long")).join(F.broadcast(table), "_dp_at", "left")
    byte = "cast(conv(hex(substring(_dp_bits, cast(_dp_h % 32768 div 8 as int) + 1, 1)), 16, 10) as int)"
    return met.withColumn("_dp_met", F.expr(f"coalesce(shiftright({byte}, cast(_dp_h % 8 as int)) & 1, 0) = 1")).select(*df.columns, "_dp_met")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component): the least node reachable, for every node that an edge names.

    edges has columns src, dst of one type. Each round takes the least label of the neighbours (partial sums go
    first, so a node of many links costs no more than others) and then the label of the label (pointer jumping);
    tables staged in the shared folder cut the lineage. A loop or a repeated edge changes nothing.
    """
    spark = edges.sparkSession
    both = staged(
        edges.where("src is not null and dst is not null and src <> dst")
        .select("src", "dst").union(edges.where("src is not null and dst is not null and src <> dst").select("dst", "src")).distinct()
    )
    held = labels = staged(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(max_rounds):
        least = (
            both.join(labels.select(F.col("node").alias("dst"), "component"), "dst")
            .groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        )
        hop = labels.join(least, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        new = staged(hop.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("component"), "was"))
        discard(held)
        held, labels = new, new.select("node", "component")
        if not new.where("component <> was").limit(1).count():
            discard(both)
            return labels
    raise RuntimeError("components did not settle")


def per_text(df: DataFrame, fn, ddl: str, text: str = "text") -> DataFrame:
    """df with further columns (ddl, names that begin with _dp_) that fn makes: a list of texts -> a list of Arrow arrays.

    Rows and other columns pass through as they are, with no shuffle.
    """
    from pyspark.sql.types import StructType

    prepare(df.sparkSession)
    new = StructType.fromDDL(ddl)
    at = df.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = fn(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *new.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *new.fields]))


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """text, label (int), fold: a repeatable sample of about `bound` labelled rows outside the held-out fold.

    The sampled labels are broadcast: their number is the stated bound, whatever the size of the tables.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_dp_y")).where(
        F.col("doc_id").isNotNull() & F.col("_dp_y").isin(0, 1) & ~held_out("doc_id")
    )
    some = thinned(known, {None: known.count()}, None, bound)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)).cast("int").alias("_dp_part")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("text", "_dp_y", part)
