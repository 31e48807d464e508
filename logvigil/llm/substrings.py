"""Removal of repeated passages: recompression names symbols, shared symbols reveal repeats, windows verify them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvigil.llm.near_dedup import _lists, mix
from logvigil.llm.scratch import Scratch
from logvigil.llm.words import word_hashes, words

WINDOW = 13
ROUNDS = 2
BATCH_WORDS = 400_000
KEYS = ("doc_id", "k1", "k2")  # what names a row: the id, where texts share an id also two hashes of the text
_PAIR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_STEP = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class Symbols:
    """One level of the parse: names, the words that a symbol covers, and the words that its existence depends on."""

    def __init__(self, name, begin, end, left, right, owner):
        self.name, self.begin, self.end, self.left, self.right, self.owner = name, begin, end, left, right, owner


def runs(word: np.ndarray, owner: np.ndarray) -> Symbols:
    """Every maximal run of a word as one symbol named by the word and the length; it depends on the word at either side."""
    at = np.arange(len(word) + 1)
    head = np.r_[True, (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])]
    begin = at[:-1][head]
    end = np.r_[begin[1:], len(word)]
    long = (end - begin).astype(np.uint64)
    name = mix(word[begin] + (long - np.uint64(1)) * _PAIR[2])
    return Symbols(name, begin, end, begin - 1, end + 1, owner[begin])


def pairs(level: Symbols, number: int) -> Symbols:
    """The next level: a name's own hash puts it in a left or a right half of the alphabet, and each left-right pair becomes one symbol.

    So a pair depends on its two symbols alone. A left symbol that stays single depends on its follower, a right one on its
    predecessor; at the edge of a document there is none, and the symbol depends on a word outside.
    """
    n = len(level.name)
    if not n:
        return level
    right_half = (mix(level.name + _PAIR[:1] * np.uint64(number)) >> np.uint64(63)).astype(bool)
    joined = level.owner[1:] == level.owner[:-1]
    pair = np.r_[~right_half[:-1] & right_half[1:] & joined, False]
    second = np.r_[False, pair[:-1]]
    next_right = np.r_[np.where(joined, level.right[1:], level.right[:-1] + 1), level.right[-1] + 1]
    prev_left = np.r_[level.left[0] - 1, np.where(joined, level.left[:-1], level.left[1:] - 1)]
    follower = np.r_[level.name[1:], np.uint64(0)]
    name = np.where(pair, mix(level.name * _PAIR[0] + follower * _PAIR[1] + np.uint64(number)), level.name)
    left = np.where(right_half, prev_left, level.left)
    right = np.where(right_half, level.right, next_right)
    end = np.where(pair, np.r_[level.end[1:], level.end[-1]], level.end)
    keep = ~second
    return Symbols(name[keep], level.begin[keep], end[keep], left[keep], right[keep], level.owner[keep])


def running_hash(word: np.ndarray) -> np.ndarray:
    """Polynomial hash of the first k words for every k, modulo 2^64; doubling the reach of a partial sum at every step."""
    total, step, reach = np.r_[np.uint64(0), mix(word)], _STEP[0], 1
    while reach < len(total):
        moved = np.zeros_like(total)
        moved[reach:] = total[:-reach]
        total = total + moved * np.uint64(pow(step, reach, 1 << 64))
        reach *= 2
    return total


def anchors(word: np.ndarray, owner: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """For each window start the name of the window's anchor: of the symbols that depend on words of the window alone, those of the highest
    level, of these the smallest name. A symbol is named together with the words that it depends on, which makes chance meetings rare.

    What such symbols are is decided by the window's words, so equal windows have equal anchors wherever they stand. Every word
    depends on itself alone, so there always is one. Starts whose window leaves the document get 0.
    """
    n = len(word)
    best = np.zeros(n, np.uint64)
    if n < window:
        return best
    inside = np.zeros(n, bool)
    inside[: n - window + 1] = owner[: n - window + 1] == owner[window - 1 :]
    at = np.arange(n)
    power = np.cumprod(np.full(window + 1, _STEP[0], np.uint64)) * pow(_STEP[0], -1, 1 << 64)
    past = running_hash(word)
    levels = [Symbols(mix(word), at, at + 1, at, at + 1, owner)]
    level = runs(word, owner)
    for number in range(1, rounds + 1):
        level = pairs(level, number)
        levels.append(level)
    open_ = inside.copy()
    for number in range(rounds, -1, -1):
        if not open_.any():
            break
        level = levels[number]
        count = window - (level.right - level.left) + 1
        fits = np.flatnonzero(count > 0)
        right, left, count = level.right[fits], level.left[fits], count[fits]
        real = (left >= 0) & (right <= n)
        right, left, count, fits = right[real], left[real], count[real], fits[real]
        own = past[right] - past[left] * power[right - left]
        first = right - window
        start = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        name = np.repeat(mix(level.name[fits] + own + np.uint64(number)) | np.uint64(1), count)
        ok = (start >= 0) & (start < n)
        start, name = start[ok], name[ok]
        ok = open_[start]
        start, name = start[ok], name[ok]
        found = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(found, start, name)
        hit = found != np.iinfo(np.uint64).max
        best[hit] = found[hit]
        open_ &= ~hit
    return best


def _groups(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``BATCH_WORDS`` list elements."""
    ends, lo = np.cumsum(np.diff(batch.column(column).offsets.to_numpy())), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BATCH_WORDS, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _flat(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all documents of a slice, each one's document, and where documents begin."""
    lists = _lists(part.column("hashes"))
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.concatenate([*lists, np.empty(0, np.uint64)]), np.repeat(np.arange(len(lists)), sizes), np.cumsum(sizes) - sizes


def _keys_at(part: pa.RecordBatch, rows: np.ndarray) -> tuple[list[pa.Array], list[str]]:
    """The columns of ``KEYS`` that a slice has, at the given rows."""
    names = [k for k in KEYS if k in part.schema.names]
    return [part.column(k).take(pa.array(rows)) for k in names], names


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _groups(batch, "hashes"):
            word, owner, begins = _flat(part)
            best = anchors(word, owner)
            head = np.r_[True, (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])] if len(best) else np.empty(0, bool)
            first = np.flatnonzero(head)
            long = np.diff(np.r_[first, len(best)])
            real = best[first] != 0
            first, long = first[real], long[real]
            key, names = _keys_at(part, owner[first])
            start = pa.array((first - begins[owner[first]]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(best[first].view(np.int64)), *key, start, pa.array(long.astype(np.int32))], ["anchor", *names, "start", "count"]
            )


def window_digests(word: np.ndarray, start: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes (64 and 32 bits) of the windows at the given starts."""
    out = []
    for step in _STEP:
        total = np.zeros(len(start), np.uint64)
        for k in range(window):
            total = (total + word[start + k]) * np.uint64(step)
            total ^= total >> np.uint64(29)
        out.append(mix(total))
    return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _groups(batch, "hashes"):
            word, _, begins = _flat(part)
            spans = [np.array([(r["start"], r["count"]) for r in x], np.int64).reshape(-1, 2) for x in part.column("spans").to_pylist()]
            owner = np.repeat(np.arange(len(spans)), [len(x) for x in spans])
            first, count = np.concatenate([*spans, np.empty((0, 2), np.int64)]).T
            at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            owner = np.repeat(owner, count)
            w1, w2 = window_digests(word, at + begins[owner])
            key, names = _keys_at(part, owner)
            yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), *key, pa.array(at.astype(np.int32))], ["w1", "w2", *names, "start"])


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with repeated windows (those that bring their words) get the count and the digest of what is left; the others pass as they are."""
    for batch in batches:
        removed, digest = batch.column("n_removed").to_pylist(), batch.column("kept_sha256").to_pylist()
        lists, starts = batch.column("words"), batch.column("starts")
        for row in np.flatnonzero(starts.is_valid().to_numpy(zero_copy_only=False)).tolist():
            word = lists[row].as_py()
            edge = np.zeros(len(word) + 1, np.int64)
            at = starts[row].values.to_numpy(zero_copy_only=False)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            gone = np.cumsum(edge)[:-1] > 0
            removed[row] = int(gone.sum())
            kept = " ".join([w for w, g in zip(word, gone.tolist(), strict=True) if not g])
            digest[row] = hashlib.sha256(kept.encode()).hexdigest()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def _text_hashes() -> dict[str, Column]:
    text = F.coalesce("text", F.lit(""))
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Row key and ``starts`` of the windows that begin in a document with a smaller id too, and row keys of whole copies
    (same text, not the smallest id), which are not in the first table. The key is ``doc_id``; if any id has several texts,
    it is ``doc_id, k1, k2`` with two hashes of the text, so that each text has windows and marks of its own.

    1. Every document is parsed by ``ROUNDS`` rounds: runs of a word, then left-right pairs of symbols, become one symbol. A name is
       a hash of what it stands for, so all tasks give equal things equal names without a shuffle. Every window has one anchor among
       the symbols it determines, and neighbouring windows mostly share it: one row stands for all of them.
    2. An anchor in one document only rules its windows out. Anchors are counted by an aggregation and joined back.
    3. Only windows of shared anchors are hashed (96 bits) and matched exactly by a second aggregation and join.

    A frequent window or anchor is aggregated before the shuffle, and its rows are split by adaptive execution in the joins.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = rows.where("doc_id IS NOT NULL")
    scratch = Scratch(docs.sparkSession)
    keyed = scratch.stage(known.select("doc_id", *[h.alias(k) for k, h in _text_hashes().items()]), "keys")
    differ = keyed.groupBy("doc_id").agg(*[(F.min(k) != F.max(k)).alias(k) for k in ("k1", "k2")]).where("k1 OR k2")
    keys = ["doc_id"] if differ.isEmpty() else [*KEYS]
    if len(keys) > 1:
        known = known.withColumns(_text_hashes())
    kinds = ", ".join(f"{k} bigint" for k in keys)
    hashed = known.select(*keys, word_hashes(F.col("text")).alias("hashes"))
    same = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = scratch.stage(keyed.join(same, ["k1", "k2"]).where("doc_id > first").select(*keys).distinct(), "copies")
    found = scratch.stage(hashed.mapInArrow(_anchor_rows, f"anchor bigint, {kinds}, start int, count int"), "anchors", even=False)
    per_anchor = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = found.join(per_anchor.where("low < high").select("anchor"), "anchor")
    per_doc = shared.groupBy(*keys).agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    live = scratch.stage(per_doc.join(copies, keys, "left_anti"), "live")
    scratch.drop(keyed, found)
    texts = known.join(live, keys).select(*keys, "spans", word_hashes(F.col("text")).alias("hashes"))
    windows = scratch.stage(texts.mapInArrow(_window_rows, f"w1 bigint, w2 int, {kinds}, start int"), "windows", even=False)
    scratch.drop(live)
    lowest = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    hits = windows.join(lowest.select("w1", "w2", "low"), ["w1", "w2"]).where("doc_id > low")
    per_doc = scratch.stage(hits.groupBy(*keys).agg(F.collect_set("start").alias("starts")), "hits")
    scratch.drop(windows)
    return per_doc, copies


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row: each word under a window of 13 words that also begins in a document with a
    smaller id is removed; windows are those of the input.

    Words are runs of anything but ASCII white space, unchanged. Texts under 13 words lose nothing; null texts have no words. Rows
    with equal ids are one document to each other and keep their own words; a null id neither gives nor loses.
    """
    hits, copies = repeated_windows(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    keys = copies.columns
    if len(keys) > 1:
        rows = rows.withColumns(_text_hashes())
    marks = hits.unionByName(copies.withColumn("starts", F.lit(None).cast("array<int>"))).groupBy(*keys).agg(
        F.first("starts", ignorenulls=True).alias("starts"), F.lit(True).alias("_marked")
    )
    both = rows.join(marks, keys, "left").withColumn("words", words(F.col("text"))).withColumn("n_words", F.size("words").cast("bigint"))
    whole = F.col("_marked").isNotNull() & (F.col("n_words") >= WINDOW)
    kept = F.when(whole, F.lit("")).otherwise(F.array_join("words", " "))
    cut = F.col("starts").isNotNull()
    sent = both.select(  # one pass, so that the texts are shuffled once
        "doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(0).alias("n_removed"),
        F.when(~cut, F.sha2(kept.cast("binary"), 256)).alias("kept_sha256"), F.when(cut, F.col("words")).alias("words"), "starts",
    )
    return sent.mapInArrow(_rest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
