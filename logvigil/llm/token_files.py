"""Token-id files: Parquet list columns, dictionary-coded ids, delta-coded keys, small row groups and pages."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logvigil.llm.encoding import WordEncoder, byte_batches, encoder, release, texts_of

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def with_end(ids: np.ndarray, begins: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts, each followed by the end id."""
    return np.insert(ids, begins[1:], end_id).astype(np.int32, copy=False), begins + np.arange(len(begins))


def _lists(coder: WordEncoder, part: pa.RecordBatch, end_id: int) -> pa.RecordBatch:
    """``doc_id, n_tokens, ids`` of a batch of texts."""
    ids, begins = with_end(*coder.ids(texts_of(part, "text")), end_id)
    lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(begins), pa.int64()), lists], ["doc_id", "n_tokens", "ids"])


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Encode every text, add the end id and write ``doc_id, n_tokens, ids`` in ascending ``doc_id`` order.

    Texts are dealt out by ranges of the key and sorted there, then encoded, so the larger ids never go through a shuffle.
    Files hold consecutive ranges. ``ids`` is a dictionary-coded list, the keys and lengths are delta-coded; row groups
    and pages are of the given sizes and Spark's writer adds page indexes, so a reader can fetch the metadata alone
    or the pages of a few keys. Null texts count as empty and give the end id alone; equal keys stand next to each
    other in the order of their texts; null keys come first.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for part in byte_batches(batch, "text"):
                yield _lists(coder, part, end_id)
                release()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(encode, f"doc_id {kind}, n_tokens bigint, ids array<int>")
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("compression", "zstd")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of the files; Spark reads the columns and row groups that a query needs."""
    return spark.read.parquet(path)


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, row, start, n_tokens`` from the metadata columns alone: the ids before each document over all files.

    A running sum inside each file, plus the totals of the files before it. ``row`` tells equal keys apart.
    """
    rows = read_token_files(spark, path).select(
        "doc_id", "n_tokens", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    return with_starts(rows)


def with_starts(rows: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Adds ``start`` to rows with ``doc_id, n_tokens, file, row``; ``counts`` are the same rows, the first three columns, read at less cost."""
    per_file = (rows if counts is None else counts).groupBy("file").agg(
        F.sum("n_tokens").alias("_sum"), F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "file")).alias("_first")
    )
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = per_file.select("file", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(bases, "file")
        .withColumn("start", F.col("_base") + F.col("_in"))
        .drop("_in", "_base")
    )


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    The ids are read once; the totals of the files come from the metadata columns. Fails where ``n_tokens`` is not a list's length.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            if not np.array_equal(np.diff(ends), batch.column("n_tokens").to_numpy(zero_copy_only=False)):
                raise ValueError("n_tokens differs from the number of ids")
            sums = [crc32(values[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64()), *map(batch.column, ("file", "row"))],
                ["doc_id", "n_tokens", "ids_crc32", "file", "row"],
            )
            release()

    rows = read_token_files(spark, path).select(
        "doc_id", "n_tokens", "ids", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    digests = rows.mapInArrow(digest, f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, file string, row bigint")
    return with_starts(digests, rows.select("doc_id", "n_tokens", "file")).select("doc_id", "start", "n_tokens", "ids_crc32")
