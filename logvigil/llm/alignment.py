"""Alignment of two tokenizers over a corpus, by diagonal run skipping.

Both tokenizers cut the same bytes. Where both end a token the text falls apart into groups; tokens of a group are linked.
The ends of the first tokenizer are a rising sequence of byte places, so are those of the second, and over most of a text
they agree one to one at some shift of the index. ``diagonal_runs`` probes such a stretch in doubling steps, jumps over it,
resolves the group behind it token by token, and goes on at the new shift; it does so in many parts of a batch at once.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.llm.encoding import byte_batches, gather, texts_of
from logvigil.llm.scratch import Scratch

BATCH_BYTES = 2 << 20  # texts are aligned in groups of about this many bytes
CACHE_CHUNKS = 600_000  # distinct chunks remembered between batches
LANE_CHUNKS = 64  # chunks of a stretch that is walked together with others
HEAD_PAIRS = 1 << 17  # the most frequent id pairs, looked up by a broadcast of that many rows; the others by a shuffle
BLOCK_LINKS = 1 << 16  # groups with more links are counted by distinct ids

# A chunk ends where a blank, tab or line feed follows another character than white space; neither tokenizer merges over such a place.
_CHUNKS = re.compile(r"\s*\S+(?:[^\S \t\n]\s*\S*)*|\s+").findall
_BLANK_PIECE = "▁"
# The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + n): b for n, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}


def diagonal_runs(a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places behind the last token of every group in either sequence of ends.

    ``cuts_a`` and ``cuts_b`` are places in the sequences, from 0 to their lengths, up to which both have the same bytes. The
    stretches between them are walked at the same time, each at its own shift.
    """
    i, j, stop, other_stop = cuts_a[:-1], cuts_b[:-1], cuts_a[1:], cuts_b[1:]
    walked = i < stop
    i, j, stop, other_stop = i[walked], j[walked], stop[walked], other_stop[walked]
    n, step = np.zeros(len(i), np.int64), np.ones(len(i), np.int64)
    runs = []
    while len(i):
        size = np.minimum(step, np.minimum(stop - i, other_stop - j) - n)
        of = np.repeat(np.arange(len(i)), size)
        place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        odd = np.flatnonzero(a[(i + n)[of] + place] != b[(j + n)[of] + place])
        odd = odd[np.concatenate(([True], of[odd][1:] != of[odd][:-1]))] if len(odd) else odd
        equal = size.copy()
        equal[of[odd]] = place[odd]
        n, step = n + equal, 2 * step
        over = (equal < size) | (i + n == stop)
        # behind a stretch of n groups of one token each the next group is resolved token by token
        x, y = (i + n)[over], (j + n)[over]
        inner = np.flatnonzero(x < stop[over])
        todo = inner
        while len(todo):
            ahead = a[x[todo]] - b[y[todo]]
            x[todo] += ahead < 0
            y[todo] += ahead > 0
            todo = todo[ahead != 0]
        x[inner] += 1
        y[inner] += 1
        runs.append((i[over], j[over], n[over], x, y))
        i, j = i.copy(), j.copy()
        i[over], j[over], n[over], step[over] = x, y, 0, 1
        left = i < stop
        i, j, n, step, stop, other_stop = (v[left] for v in (i, j, n, step, stop, other_stop))
    if not runs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, other, lengths, x, y = (np.concatenate(v) for v in zip(*runs))
    order = np.argsort(at)
    at, other, lengths, x, y = at[order], other[order], lengths[order], x[order], y[order]
    behind = x > at + lengths
    sizes = lengths + behind
    last = np.cumsum(sizes) - 1
    inside = np.arange(int(sizes.sum())) - np.repeat(last + 1 - sizes, sizes) + 1
    ends_a, ends_b = np.repeat(at, sizes) + inside, np.repeat(other, sizes) + inside
    ends_a[last[behind]], ends_b[last[behind]] = x[behind], y[behind]
    return ends_a, ends_b


def linked_pairs(
    ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, owner: np.ndarray, sizes: tuple[int, int]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, ``a * sizes[1] + b`` and number of links of every distinct id pair that an owner's groups link."""
    n_a, n_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    from_a, from_b, links = ends_a - n_a, ends_b - n_b, n_a * n_b
    small = links <= BLOCK_LINKS
    of = np.repeat(np.flatnonzero(small), links[small])
    place = np.arange(len(of)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
    base = owner * (sizes[0] * sizes[1])
    keys, times = np.unique(
        base[of] + ids_a[from_a[of] + place // n_b[of]] * sizes[1] + ids_b[from_b[of] + place % n_b[of]], return_counts=True
    )
    if not small.all():
        parts = [(keys, times)]
        for g in np.flatnonzero(~small):
            a, many_a = np.unique(ids_a[from_a[g] : ends_a[g]], return_counts=True)
            b, many_b = np.unique(ids_b[from_b[g] : ends_b[g]], return_counts=True)
            parts.append((base[g] + (a[:, None] * sizes[1] + b).ravel(), (many_a[:, None] * many_b).ravel()))
        all_keys, all_times = (np.concatenate(v) for v in zip(*parts))
        keys, which = np.unique(all_keys, return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, which, all_times)
    return keys // (sizes[0] * sizes[1]), keys % (sizes[0] * sizes[1]), times


class PairEncoder:
    """Ids of both tokenizers, whose tokens have the same bytes.

    Neither tokenizer merges over the begin of a run of blanks, so a text is cut there and every distinct chunk is encoded
    once by either library. A chunk whose tokens do not spell it marks its text as not alignable.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread: Spark runs a task per core
        from pathlib import Path

        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        model = ModelProto.FromString(Path(path_b).read_bytes())
        model.normalizer_spec.add_dummy_prefix = False  # the blank before the text is given with it
        self.b = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.width = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.width)]
        if any(c in f"{_BLANK_PIECE} \t\n" for p in pieces for c in p.lstrip(_BLANK_PIECE)[1:]):
            raise ValueError("the second tokenizer merges over blanks")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK_PIECE, " ").encode() for i, p in enumerate(pieces)
        ]
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.bytes_a = [bytes(_BYTE_OF.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(size)]
        self.long_a, self.long_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # what follows an id in the list of groups: another id of its side, or the other side or the next group
        self.shown = pa.array(
            [f"{i}{sep}" for i in range(size) for sep in ",|"] + [f"{i}{sep}" for i in range(self.width) for sep in ",;"]
        )
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.good = np.empty(0, bool)
        self.tables = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in "ab"]

    def _learn(self, chunks: list[str]) -> None:
        for chunk in chunks:
            self.code[chunk] = len(self.code)
        lists_a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        lists_b = self.b.encode(chunks, num_threads=1)
        good = np.ones(len(chunks), bool)
        spelt = "".join(chunks).encode()
        for table, lists in ((self.bytes_a, lists_a), (self.bytes_b, lists_b)):
            if b"".join(map(table.__getitem__, chain.from_iterable(lists))) != spelt:
                good &= [b"".join(map(table.__getitem__, ids)) == c.encode() for ids, c in zip(lists, chunks)]
        self.good = np.concatenate((self.good, good))
        for side, lists in enumerate((lists_a, lists_b)):
            ids, begins, sizes = self.tables[side]
            new = np.array([len(x) for x in lists], np.int64)
            self.tables[side] = (
                np.concatenate((ids, np.fromiter(chain.from_iterable(lists), np.int64))),
                np.concatenate((begins, len(ids) + np.cumsum(new) - new)),
                np.concatenate((sizes, new)),
            )

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """For either side all ids of the texts, how many every text has, and places of chunks' ends among them.

        Texts that cannot be aligned have none.
        """
        if len(self.code) > CACHE_CHUNKS:
            self._forget()
        lists = [_CHUNKS(f" {text}") if text else [] for text in texts]
        chunks = list(chain.from_iterable(lists))
        code = np.fromiter(map(self.code.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(code < 0).tolist()
        if new:
            unseen = [chunks[k] for k in new]
            self._learn(list(dict.fromkeys(unseen)))
            code[new] = np.fromiter(map(self.code.__getitem__, unseen), np.int64, len(new))
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in lists])
        bad = np.bincount(owner, weights=~self.good[code], minlength=len(texts)) > 0
        code, owner = code[~bad[owner]], owner[~bad[owner]]
        ids, counts, cuts = [], [], []
        for table, begins, sizes in self.tables:
            long = sizes[code]
            ids.append(gather(table, begins[code], long))
            counts.append(np.bincount(owner, weights=long, minlength=len(texts)).astype(np.int64))
            ends = np.cumsum(long)
            cuts.append(np.concatenate(([0], ends[LANE_CHUNKS - 1 :: LANE_CHUNKS], ends[-1:])))
        return ids, counts, cuts

    def align(self, texts: list[str]) -> dict[str, pa.Array]:
        """Columns of the texts: tokens, groups, links, the digest of the groups, and the distinct linked id pairs."""
        (ids_a, ids_b), (n_a, n_b), cuts = self.encode(texts)
        # the texts stand one behind the other: every text's end is an end of both
        ends_a, ends_b = diagonal_runs(np.cumsum(self.long_a[ids_a]), np.cumsum(self.long_b[ids_b]), *cuts)
        owner = np.searchsorted(np.cumsum(n_a), ends_a - 1, side="right")
        sizes_a, sizes_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        sums = [
            np.bincount(owner, weights=w, minlength=len(texts)).astype(np.int64) for w in (np.ones(len(owner)), sizes_a * sizes_b)
        ]
        who, pairs, times = linked_pairs(ids_a, ids_b, ends_a, ends_b, owner, (len(self.bytes_a), self.width))
        per_text = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(texts))))).astype(np.int32)
        kind = pa.int32() if len(self.bytes_a) * self.width < 1 << 31 else pa.int64()
        offsets = pa.array(per_text, pa.int32())
        return {
            "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(sums[0]), "n_links": pa.array(sums[1]),
            "groups_sha256": pa.array(self._digests(ids_a, ids_b, ends_a, ends_b, n_a + n_b), pa.string()),
            "pairs": pa.ListArray.from_arrays(offsets, pa.array(pairs, kind)),
            "times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
        }

    def _digests(self, ids_a, ids_b, ends_a, ends_b, tokens: np.ndarray) -> list[str]:
        """Of every text the sha256 of its groups' ids, as ``a1,a2|b1;a3|b2,b3``."""
        shown = np.empty(len(ids_a) + len(ids_b), np.int64)
        sizes_a, sizes_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[ends_a - 1], last_b[ends_b - 1] = 1, 1
        # a token of the first side stands behind the second side's tokens of the groups before, and the other way round
        shown[np.arange(len(ids_a)) + np.repeat(ends_b - sizes_b, sizes_a)] = 2 * ids_a + last_a
        shown[np.arange(len(ids_b)) + np.repeat(ends_a, sizes_b)] = 2 * (len(self.bytes_a) + ids_b) + last_b
        line = self.shown.take(pa.array(shown))
        text = memoryview(line.buffers()[2]) if len(line) else memoryview(b"")
        place = np.frombuffer(line.buffers()[1], np.int32)[: len(line) + 1] if len(line) else np.zeros(1, np.int32)
        cut = place[np.concatenate(([0], np.cumsum(tokens)))].tolist()
        return ["" if lo == hi else hashlib.sha256(text[lo : hi - 1]).hexdigest() for lo, hi in zip(cut, cut[1:])]


@lru_cache(maxsize=1)
def pair_encoder(path_a: str, path_b: str) -> PairEncoder:
    """The encoder of this worker."""
    return PairEncoder(path_a, path_b)


def aligned(docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, a row number, counts, digest, and its distinct id pairs (``a * width + b``) with their links."""
    size_a, size_b = _sizes(byte_tokenizer, piece_tokenizer)
    key = "int" if size_a * size_b < 1 << 31 else "bigint"
    kind = docs.schema[id_col].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pair_encoder(byte_tokenizer, piece_tokenizer)
        for batch in batches:
            for part in byte_batches(batch, "text", BATCH_BYTES):
                found = {"row": part.column("row"), "doc_id": part.column("doc_id")} | coder.align(texts_of(part, "text"))
                yield pa.RecordBatch.from_arrays(list(found.values()), list(found))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        align,
        f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        f"pairs array<{key}>, times array<bigint>",
    )


@lru_cache(maxsize=4)
def _sizes(byte_tokenizer: str, piece_tokenizer: str) -> tuple[int, int]:
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_tokenizer).get_vocab_size(), SentencePieceProcessor(model_file=piece_tokenizer).get_piece_size()


def pair_counts(held: DataFrame, width: int) -> DataFrame:
    """``pair, n, best``: how many rows hold an id pair linked, and whether no pair of its first id is held by more."""
    counts = held.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    first = f"pair div {width}"
    # as many rows as the first vocabulary has ids at most
    top = counts.groupBy(F.expr(first).alias("_a")).agg(F.max("n").alias("_top"))
    return counts.join(F.broadcast(top), F.expr(f"{first} = _a")).selectExpr("pair", "n", "n = _top AS best")


def align_tokenizers(
    docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``byte_tokenizer`` is a byte-level tokenizer file, ``piece_tokenizer`` a sentence piece model with byte fallback. A pair's
    count is the number of rows that hold it linked; ``n_best`` counts links whose count is the highest of their first id,
    ``count_sum`` adds the counts of all links. Null and empty texts, and texts that the tokens of either side do not spell,
    have zeros and an empty digest; repeated rows and null ids count like others; other columns are ignored.

    Rows leave Python with their distinct pairs, which are staged once. The counts are aggregated before they are
    shuffled. They come back to the rows by a broadcast of the ``HEAD_PAIRS`` most frequent pairs; the pairs beyond them, none of
    which is frequent, are joined by a shuffle and added up per row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    held = scratch.stage(aligned(docs, byte_tokenizer, piece_tokenizer, id_col, text_col), "aligned", even=False)
    counts = scratch.stage(pair_counts(held, _sizes(byte_tokenizer, piece_tokenizer)[1]), "pair-counts")
    head = F.broadcast(counts.orderBy(F.desc("n"), "pair").limit(HEAD_PAIRS))
    links = held.selectExpr("row", "inline(arrays_zip(pairs, times)) AS (pair, times)")
    sums = [F.expr("sum(if(best, times, 0)) AS best"), F.expr("sum(times * n) AS total")]
    often = links.join(head, "pair").groupBy("row").agg(*sums)
    seldom = links.join(head, "pair", "left_anti").join(counts, "pair").groupBy("row").agg(*sums)
    per_row = often.unionByName(seldom).groupBy("row").agg(F.sum("best").alias("best"), F.sum("total").alias("total"))
    return held.drop("pairs", "times").join(per_row, "row", "left").selectExpr(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "coalesce(best, 0) AS n_best", "coalesce(total, 0) AS count_sum", "groups_sha256"
    )
