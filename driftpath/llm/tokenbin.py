"""Token ids in files of blocks: one zstandard frame for each document, one shared dictionary, an index of offsets.

File format. A data set is a folder with two Parquet tables, which Spark's committer writes whole or not at all:
`dictionary` (dict_hash string, sha256 of the dictionary; dictionary binary) and `blocks`, one row for each block of at
most `block_docs` documents in ascending doc_id order: file int, block int, first_doc long, last_doc long, dict_hash,
doc_ids array<long>, n_tokens array<long>, offsets array<long> (one more than documents), payload binary. The frame of
the k-th document is payload[offsets[k]:offsets[k + 1]]; it holds little-endian unsigned 32-bit ids. first_doc and
last_doc let a reader skip blocks by Parquet statistics, and the offsets let it decompress one document alone.

The dictionary is trained on a bounded sample: about `sample_docs` documents by hash of doc_id, of those with at most
`sample_bytes` of serialized ids. It changes the size of files only, never their meaning.

Null and empty texts are documents of the end id alone. A null doc_id comes first; rows of the same doc_id are all
written, in the order of their texts. An empty table makes no block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import prepare, staged_path, thinned

BLOCKS = "file int, block int, first_doc long, last_doc long, dict_hash string, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"


def _ids(tokenizer: str, end_id: int, texts: list) -> Iterator[bytes]:
    end = int(end_id).to_bytes(4, "little")
    return (raw + end for raw in tokens.encoded(tokenizer, texts))


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = 1, sample_docs: int = 512, sample_bytes: int = 1 << 15, dict_bytes: int = 1 << 16) -> bytes:
    """Empty if there is too little to train on."""
    import zstandard

    prepare(docs.sparkSession)

    def raw(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(_ids(tokenizer, end_id, b.column(0).to_pylist())), pa.binary())], ["raw"])

    short = docs.where(F.length("text") <= sample_bytes // 2)
    some = thinned(short, {None: short.count()}, None, sample_docs).select("text")
    found = [bytes(r.raw) for r in some.mapInArrow(raw, "raw binary").where(F.length("raw") <= sample_bytes).collect()]
    try:
        return zstandard.train_dictionary(dict_bytes, found).as_bytes() if len(found) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_docs: int = 256, level: int = 3, files: int | None = None, **sample) -> None:
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = train_dictionary(docs, tokenizer, end_id, **sample)
    key = hashlib.sha256(shared).hexdigest()
    spark.createDataFrame([(key, shared)], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(shared) if shared else None, write_dict_id=False)
        held: list[tuple] = []
        made, size = 0, 0

        def out():
            nonlocal made, size
            offsets = [0]
            for _, _, frame in held:
                offsets.append(offsets[-1] + len(frame))
            ids = [x[0] for x in held]
            known = [i for i in ids if i is not None]
            row = [file, made, min(known, default=None), max(known, default=None), key, ids, [x[1] for x in held], offsets, b"".join(x[2] for x in held)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            names = [x.split()[0] for x in BLOCKS.split(", ")]
            made, size = made + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        file = 0
        for b in batches:
            for doc, raw, part in zip(b.column(0).to_pylist(), _ids(tokenizer, end_id, b.column(1).to_pylist()), b.column(2).to_pylist(), strict=True):
                file = part
                frame = press.compress(raw)
                held.append((doc, len(raw) // 4, frame))
                size += len(frame)
                if len(held) >= block_docs or size >= 1 << 24:
                    yield out()
        if held:
            yield out()

    dealt = docs.repartitionByRange(files, "doc_id") if files else docs.repartitionByRange("doc_id")
    dealt.sortWithinPartitions("doc_id", "text").withColumn("file", F.spark_partition_id()).mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(row.dictionary)).hexdigest() != row.dict_hash:
        raise ValueError(f"the dictionary in {path} does not match its hash")
    return row.dict_hash, bytes(row.dictionary)


def read_ids(spark: SparkSession, path: str, digest: bool = False, where: str | None = None) -> DataFrame:
    """doc_id, file, block, k, n_tokens and ids (binary), or with digest their crc32 instead of them."""
    prepare(spark)
    key, shared = _dictionary(spark, path)

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
        for b in batches:
            for r in b.to_pylist():
                if r["dict_hash"] != key:
                    raise ValueError(f"block {r['block']} of file {r['file']} was made with another dictionary")
                view, at = memoryview(r["payload"]), r["offsets"]
                raw = [d.decompress(view[at[k] : at[k + 1]]) for k in range(len(at) - 1)]
                n = len(raw)
                cols = [(r["doc_ids"], pa.int64()), ([r["file"]] * n, pa.int32()), ([r["block"]] * n, pa.int32()), (list(range(n)), pa.int32()), ([len(x) // 4 for x in raw], pa.int64())]
                cols.append(([zlib.crc32(x) for x in raw], pa.int64()) if digest else (raw, pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cols], ["doc_id", "file", "block", "k", "n_tokens", "x"])

    found = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    found = found.where(where) if where else found
    out = found.mapInArrow(rows, f"doc_id long, file int, block int, k int, n_tokens long, x {'long' if digest else 'binary'}")
    return out.withColumnRenamed("x", "ids_crc32" if digest else "ids")


def read_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The ids of one document, from the blocks whose range of ids holds it."""
    near = read_ids(spark, path, where=f"first_doc <= {int(doc_id)} and last_doc >= {int(doc_id)}")
    return near.where(F.col("doc_id") == int(doc_id))


def starts(spark: SparkSession, path: str) -> DataFrame:
    """file, block, start: the number of ids before each block, from the blocks' indexes alone.

    Sums by file go first; only they meet in one task (one row for each file).
    """
    index = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("file", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    by_file = index.groupBy("file").agg(F.sum("n").alias("n"))
    before = by_file.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("inside", F.coalesce(F.sum("n").over(w), F.lit(0))).join(before, "file").select("file", "block", (F.col("base") + F.col("inside")).alias("start"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None, **kw) -> DataFrame:
    """Write all documents, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or staged_path(spark)
    write_ids(docs, path, tokenizer, end_id, **kw)
    w = Window.partitionBy("file", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = read_ids(spark, path, digest=True).withColumn("inside", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    return rows.join(starts(spark, path), ["file", "block"]).select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
