"""From raw documents to packed sequences: five stages, each over all that the one before kept.

Toxic documents go; later copies of line runs go from the texts; of each group of near duplicates one document stays;
documents that hold benchmark items go; the rest is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftpath.llm import decontam, linededup, packing, shingledup, toxicity
from driftpath.llm.common import staged_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; trained as in op2 on the documents given."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("_dp_score < 0.3").select(*docs.columns)


def drop_line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of 50 words or more; a document all of whose lines go stays, empty."""
    out = linededup.dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.size("_dp_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group linked by a Jaccard similarity of 0.8 or more over shingles of five words."""
    return shingledup.one_of_each(docs, shingle=5, least=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item has half of its words or more in tiles."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("_dp_found") == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids and their places in sequences, as op1 has them."""
    import public_tokenizers

    return packing.pack_documents(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", keep_civil), ("line_dedup", drop_line_copies), ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark), ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{staged_path(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
