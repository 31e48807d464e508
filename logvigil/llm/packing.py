"""Vector bin packing of token pieces under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.llm.encoding import byte_batches, encoder, release, texts_of
from logvigil.llm.token_files import crc32, with_end
from logvigil.session import stage

CAPACITY = 2048
SEGMENTS = 256
GRAIN = 128
GROUP_ROWS = 6000
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def cut_points(n_tokens: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """Where a document of ``n_tokens`` is cut: full sequences, then a multiple of ``grain``, then the rest."""
    cuts = list(range(0, n_tokens, capacity))
    rest = n_tokens % capacity
    if rest > grain and rest % grain:
        cuts.append(n_tokens - rest % grain)
    return [*cuts, n_tokens]


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: every document's ids and end id, cut for packing.

    Only places and digests leave Python, never the ids. Null texts count as empty and give the end id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for part in byte_batches(batch, "text"):
                ids, begins = with_end(*coder.ids(texts_of(part, "text")), end_id)
                owner, start, length, crc, total = [], [], [], [], []
                for k, (lo, hi) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
                    cuts = cut_points(hi - lo, capacity)
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        owner.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(crc32(ids[lo + a : lo + b]))
                        total.append(hi - lo)
                keys = part.column("doc_id").take(pa.array(owner, pa.int64()))
                values = [pa.array(v, pa.int64()) for v in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays([keys, *values], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                release()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, {PIECES}")


def place(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and order in the bin of every item; ``demand`` has a row per item and a column per limited quantity.

    The dot-product heuristic: the open bin takes the item that fits and has the largest product of its demands and what is
    left of the bin, both as shares of the limits and weighted by the mean demand; if none fits, the next bin is
    opened. Items of equal demand are interchangeable, so the choice is made among distinct demands. Items beyond a limit
    get a bin of their own.
    """
    bins, order = np.zeros(len(demand), np.int64), np.zeros(len(demand), np.int64)
    share = demand / limits
    alone = (share > 1).any(axis=1)
    bins[alone] = np.arange(alone.sum())
    opened = int(alone.sum())
    rest = np.flatnonzero(~alone)
    if not len(rest):
        return bins, order
    kinds, of = np.unique(demand[rest], axis=0, return_inverse=True)
    waiting = [rest[of == k].tolist()[::-1] for k in range(len(kinds))]
    count = np.array([len(w) for w in waiting])
    size = kinds / limits
    score = size * (size * count[:, None]).sum(axis=0) / count.sum()
    while len(kinds):
        left, row = limits.astype(np.float64).copy(), 0
        while True:
            fits = ((kinds <= left) & (count > 0)[:, None]).all(axis=1)
            if not fits.any():
                break
            k = int(np.argmax(np.where(fits, score @ (left / limits), -1.0)))
            item = waiting[k].pop()
            count[k] -= 1
            bins[item], order[item] = opened, row
            left -= kinds[k]
            row += 1
        opened += 1
        if (count == 0).mean() > 0.2:
            keep = count > 0
            kinds, score, count = kinds[keep], score[keep], count[keep]
            waiting = [w for w, k in zip(waiting, keep, strict=True) if k]
        if not count.any():
            break
    return bins, order


def pack(pieces: DataFrame, limits: dict[str, int], size: str, key: list[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; no sequence exceeds any of ``limits`` (column: limit).

    Pieces are dealt by a hash of ``key`` into groups of about ``group_rows`` rows, each packed on its own by :func:`place`, so the
    work is linear in the rows and no key can make a group large; at most one sequence per group is left nearly empty.
    Null demands count as 0. ``size`` is the column that offsets run over. Repeated rows are packed each for itself.
    """
    n_groups = max(1, -(-pieces.count() // group_rows))
    columns, names = pieces.columns, list(limits)
    capacity = np.array([limits[n] for n in names], np.float64)

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable").reset_index(drop=True)
        demand = rows[names].fillna(0).to_numpy(np.float64)
        bins, order = place(demand, capacity)
        rows["sequence_id"] = rows["_group"].astype("int64") * (1 << 32) + bins
        by = np.lexsort((order, bins))
        long = rows[size].fillna(0).to_numpy(np.int64)[by]
        ends = np.cumsum(long) - long
        first = np.r_[True, np.diff(bins[by]) != 0] if len(by) else np.empty(0, bool)
        offset = np.empty(len(by), np.int64)
        offset[by] = ends - np.repeat(ends[first], np.diff(np.r_[np.flatnonzero(first), len(by)]))
        rows["offset"] = offset
        return rows[[*columns, "sequence_id", "offset"]]

    schema = f"{', '.join(f'`{n}` {t}' for n, t in pieces.dtypes)}, sequence_id bigint, offset bigint"
    spread = pieces.withColumn("_group", F.pmod(F.xxhash64(*key), F.lit(n_groups)))
    return spread.groupBy("_group").applyInPandas(fill, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_tokens: int = CAPACITY
) -> DataFrame:
    """All documents as pieces in sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ...``.

    A piece's segments count 1; its loss-bearing tokens (``loss_tokens`` column) are all but a document's first, which
    nothing predicts. By default their limit is the capacity, which never binds. The pieces are written once to the shared folder, as encoding is the costly step.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity).withColumns(
        {"segments": F.lit(1).cast("bigint"), "loss_tokens": F.col("length") - (F.col("start") == 0).cast("bigint")}
    )
    staged = stage(pieces, "pieces")
    limits = {"length": capacity, "segments": segments, "loss_tokens": loss_tokens}
    return pack(staged, limits, "length", ["doc_id", "start", "ids_crc32", "doc_tokens"])
