"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.llm.encoding import byte_batches, encoder, texts_of


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, without special tokens.

    ``tokenizer`` is the place of a tokenizer file that drops white space. Batches are cut by bytes and long
    texts at blanks, so memory does not follow the longest text's tokens; only lengths leave Python, nothing is shuffled.
    Null and empty texts count 0; repeated rows and null ids are kept as they are; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for part in byte_batches(batch, "text"):
                n_tokens = pa.array(coder.counts(texts_of(part, "text")), pa.int64())
                n_bytes = pc.cast(pc.fill_null(pc.binary_length(part.column("text")), 0), pa.int64())
                over = pc.greater(n_tokens, limit)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), n_bytes, n_tokens, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
