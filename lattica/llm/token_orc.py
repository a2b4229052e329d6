"""Token ids as ORC files in ascending document order.

ORC keeps integers run-length encoded in stripes, each with a row index and a Bloom filter of the document ids. Readers
take stripes in parallel and skip those whose statistics or filters exclude the ids asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import whole
from lattica.llm.tokenizing import NO_BLANK, documents_with_end, encoder

STORED = "doc_id long, local_start long, n_tokens long, ids array<int>"


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, pattern: str = NO_BLANK, stripe_bytes: int = 16 << 20, index_stride: int = 5000) -> None:
    """Writes doc_id, local_start (ids before it in its file), n_tokens and ids, with ``end_id`` closing each document.

    Texts are dealt out by ranges of doc_id and sorted before they are encoded, so no ids are shuffled. Null texts
    count as empty, rows with a null doc_id come first, and repeated rows are written as often as they occur. Each task
    writes one file, whatever the session says of records in a file: places are counted within files.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before = encoder(tokenizer, pattern), 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for first, ids, lengths in documents_with_end(coder, texts, end_id):
                ends = np.cumsum(lengths)
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(first, len(lengths)), pa.array(before + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))],
                    ["doc_id", "local_start", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(index_stride), "orc.stripe.size": str(stripe_bytes), "compression": "zstd", "maxRecordsPerFile": "0"}
    ordered.mapInArrow(encode, STORED).write.options(**options).orc(path)


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows, or those of ``doc_ids`` (pushed down to row indexes and Bloom filters)."""
    stored = spark.read.schema(STORED).orc(path)
    return stored if doc_ids is None else stored.filter(F.col("doc_id").isin(list(doc_ids)))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, all from the files at ``path``.

    Only the lengths are summed for each file, and only those sums meet: a row for each file.
    """
    stored = spark.read.schema(STORED).orc(path).withColumn("_file", F.col("_metadata.file_path"))
    files = stored.groupBy("_file").agg(F.sum("n_tokens").alias("_total"), F.min("doc_id").alias("_least"), F.max(F.col("doc_id").isNull()).alias("_null"))
    order = Window.orderBy(F.desc("_null"), F.asc_nulls_first("_least"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_total").over(order), F.lit(0)).alias("_base"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_file"), batch.column("local_start"), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "_file", "local_start", "n_tokens", "ids_crc32"])

    read = stored.mapInArrow(checked, "doc_id long, _file string, local_start long, n_tokens long, ids_crc32 long")
    return read.join(files, "_file").select("doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
