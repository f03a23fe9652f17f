"""Token ids in ORC files that can be read by stripe and pruned by their metadata.

Documents are range-sorted by id before they are encoded (so only texts are shuffled, and the
sampling for the ranges never tokenises), then written with ORC's integer run-length encoding, a
row index every ``ROW_INDEX`` rows and a Bloom filter on the document ids. Each range is one file, a shard, and ``at``
numbers its rows. A small table beside the files, ``_shards``, has each shard's file and least and largest id, so a reader
of some ids opens only the files that may hold them, then stripes by their statistics, then row groups by the Bloom filter.

A null id sorts first; rows with the same id are all kept, in the order of a hash of their texts, and may span shards, so an id
that a third of all rows have is no load. Null or empty texts are the end id alone. An empty table writes no rows and reads back
empty. Other columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common, tokens

STRIPE_BYTES = 16 << 20
ROW_INDEX = 1_000
BLOOM_FPP = 0.01
_SCHEMA = "doc_id long, n_tokens long, ids array<int>, shard int, at long"
_SHARDS = "shard int, file string, least long, largest long, nulls long, n_rows long"


def write_orc(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text", shards: int | None = None) -> None:
    """Encode ``text``, append ``end_id`` and write one sorted ORC shard per id range under ``path``."""
    spark = df.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = common.in_small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Rows equal in id and text are dealt out by where they were read: any order of them is the same.
    order = [F.col("doc_id").asc_nulls_first(), F.col("same")]
    ranged = rows.withColumns({"same": F.xxhash64("text"), "where": F.monotonically_increasing_id()}).repartitionByRange(n, *order, F.col("where")).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard, at = tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            ids, ends = enc.encode(b.column(1), end_id)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends)), lists, pa.array(np.full(len(lists), shard, np.int32)), pa.array(np.arange(at, at + len(lists)))], names=["doc_id", "n_tokens", "ids", "shard", "at"])
            at += len(lists)

    (
        ranged.select("doc_id", "text").mapInArrow(encode, _SCHEMA).write.mode("overwrite")
        .option("orc.compress", "ZSTD").option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", ROW_INDEX)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_FPP)
        .orc(path)
    )
    # One row per shard, from the ids' columns alone.
    written = spark.read.schema(_SCHEMA).orc(path).select("shard", "doc_id", F.col("_metadata.file_name").alias("file"))
    nulls = F.sum(F.col("doc_id").isNull().cast("long"))
    written.groupBy("shard", "file").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("largest"), nulls.alias("nulls"), F.count("*").alias("n_rows")).coalesce(1).write.parquet(f"{path}/_shards")


def read_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The written rows (doc_id, n_tokens, ids, shard, at). With a list of ids only the shards that may hold one are read, and the ids are pushed down to the files' statistics and Bloom filters."""
    if doc_ids is None:
        return spark.read.schema(_SCHEMA).orc(path)
    asked = spark.createDataFrame([(int(d),) for d in doc_ids], "asked long")
    shards = spark.read.schema(_SHARDS).parquet(f"{path}/_shards")
    files = [r[0] for r in shards.join(F.broadcast(asked), F.col("asked").between(F.col("least"), F.col("largest")), "left_semi").select("file").collect()]
    if not files:
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).orc([f"{path}/{f}" for f in files]).where(F.col("doc_id").isin(doc_ids))


def digest(rows: DataFrame) -> DataFrame:
    """Per document of ``read_orc``: doc_id, start (ids before it in the whole sequence), n_tokens and the CRC-32 of its ids."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1)
            ends, flat = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            sums = [zlib.crc32(flat[4 * x : 4 * y]) for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64()), b.column(2), b.column(3)], names=["doc_id", "n_tokens", "ids_crc32", "shard", "at"])

    found = common.materialise(rows.select("doc_id", "ids", "shard", "at").mapInArrow(crc, "doc_id long, n_tokens long, ids_crc32 long, shard int, at long"), "token-digests")
    # One row per shard, so the running total over shards is small; within a shard it is one task's range.
    per_shard = found.groupBy("shard").agg(F.sum("n_tokens").alias("__all"))
    before = per_shard.withColumn("__before", F.coalesce(F.sum("__all").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__all")
    in_order = Window.partitionBy("shard").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(in_order), F.lit(0)) + F.col("__before")
    return found.join(F.broadcast(before), "shard").select("doc_id", start.cast("long").alias("start"), "n_tokens", "ids_crc32")
