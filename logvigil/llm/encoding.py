"""Batch encoding of whole texts with a public tokenizer file, inside Arrow functions.

The tokenizer drops white space before it merges, so no token crosses a blank and every
blank is a safe boundary: the ids of a text are the ids of its words, one after the other. A batch of
texts is therefore split into words, each distinct word is encoded once by the library, and the results
are dealt back to the texts. Words are kept raw: case, accents and special strings are left to the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 8 << 20  # texts are encoded in groups of about this many bytes
PIECE_CHARS = 2 << 20  # longer texts are cut at blanks into pieces of about this size
CACHE_PARTS = 400_000  # distinct parts of words remembered between batches
BLOCK_WORDS = 20_000  # distinct words that are strings of Python at a time
GATHER_RUNS = 1 << 16  # runs that are copied at a time

# The split pattern of the tokenizer file, and what it comes to for lower-case words of the plain characters.
_FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BREAK = "\n"
_PARTS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+").findall
_PLAIN = r"^[!-~À-ÖØ-öø-ÿ]+$"
# The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + n) for n, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}
_BLANK = re.compile(r"[\x20\x09-\x0d]")


def cut_at_blanks(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """Pieces of at least ``limit`` characters (the last may be shorter), cut at white space only."""
    pieces, at = [], 0
    while len(text) - at > limit:
        blank = _BLANK.search(text, at + limit)
        if blank is None:
            break
        pieces.append(text[at : blank.start()])
        at = blank.start()
    pieces.append(text[at:])
    return pieces


def gather(table: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``table`` that begin and last as given, one after the other."""
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, table.dtype)
    for lo in range(0, len(ends), GATHER_RUNS):  # the places take four times the room of the ids
        part = slice(lo, lo + GATHER_RUNS)
        first, last = int(ends[lo] - sizes[lo]), int(ends[part][-1])
        places = np.repeat(begins[part] - (ends[part] - sizes[part]), sizes[part])
        places += np.arange(first, last)
        out[first:last] = table[places]
    return out


class WordEncoder:
    """Encodes distinct words with the library.

    Words of printable ASCII and Latin-1 letters need no normalization but lower case: they are split as the
    tokenizer file's own pattern splits them, and each part not seen before goes to the library's merge model. All
    others, and words that might hold a special string, go through the library's full encoder. A file with another
    normalizer or pattern uses the full encoder throughout.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread: Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        described = json.loads(self.tokenizer.to_str())
        steps = described["normalizer"] or {}
        self.plain = (
            [n["type"] for n in steps.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [p.get("pattern", {}).get("Regex") for p in described["pre_tokenizer"]["pretokenizers"]] == [_FILE_PATTERN, None]
            and all("<|" in t["content"] for t in described["added_tokens"])
        )
        self._forget()

    def _forget(self) -> None:
        self.code = {_BREAK: 0}  # the break between words has no ids
        self.table, self.begins, self.sizes = np.empty(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _learn(self, parts: list[str]) -> None:
        """Give every new part a number and its ids."""
        ids, sizes, tokenize = [], [], self.tokenizer.model.tokenize
        for part in parts:
            self.code[part] = len(self.code)
            tokens = tokenize(part if part.isascii() else "".join(_BYTE_CHARS[b] for b in part.encode()))
            sizes.append(len(tokens))
            ids.extend([t.id for t in tokens])
        new = np.array(sizes, np.int64)
        self.begins = np.concatenate((self.begins, len(self.table) + np.cumsum(new) - new))
        self.sizes = np.concatenate((self.sizes, new))
        self.table = np.concatenate((self.table, np.array(ids, np.int32)))

    def _simple(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of plain characters, and how many each has; in blocks, as what is remembered keeps the memory around it."""
        blocks = [self._block(words.slice(lo, BLOCK_WORDS)) for lo in range(0, len(words), BLOCK_WORDS)]
        ids, sizes = zip(*blocks, strict=True) if blocks else ([np.empty(0, np.int32)], [np.empty(0, np.int64)])
        return np.concatenate(ids), np.concatenate(sizes)

    def _block(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = _PARTS(_BREAK.join(words.to_pylist()).lower())
        if len(self.code) > CACHE_PARTS:
            self._forget()
        codes = list(map(self.code.get, parts))
        new = [parts[k] for k, code in enumerate(codes) if code is None]
        if new:
            self._learn(list(dict.fromkeys(new)))
            codes = map(self.code.get, parts)
        code = np.fromiter(codes, np.int64, len(parts))
        sizes = np.bincount(np.cumsum(code == 0), weights=self.sizes[code], minlength=len(words))
        return gather(self.table, self.begins[code], self.sizes[code]), sizes.astype(np.int64)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids, and for every word where its ids begin there and how many they are."""
        simple = np.zeros(len(words), bool)
        if self.plain:
            mask = pc.and_not(pc.match_substring_regex(words, _PLAIN), pc.match_substring(words, "<|"))
            simple = mask.to_numpy(zero_copy_only=False)
        easy_ids, easy = self._simple(words.filter(pa.array(simple)))
        hard, ids = words.filter(pa.array(~simple)).to_pylist(), []
        for lo in range(0, len(hard), BLOCK_WORDS):
            coded = self.tokenizer.encode_batch_fast(hard[lo : lo + BLOCK_WORDS], add_special_tokens=False)
            ids += [one.ids for one in coded]
        sizes = np.empty(len(words), np.int64)
        sizes[simple], sizes[~simple] = easy, np.fromiter(map(len, ids), np.int64, len(ids))
        order = np.argsort(~simple, kind="stable")
        begins = np.empty(len(words), np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate((easy_ids, np.fromiter(chain.from_iterable(ids), np.int32))), begins, sizes

    def _split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Owner text and distinct word of every word, and the ids of the distinct words."""
        pieces, owner = [], []
        for k, text in enumerate(texts):
            for piece in cut_at_blanks(text):
                pieces.append(piece)
                owner.append(k)
        lists = pc.ascii_split_whitespace(pa.array(pieces, pa.large_string()))
        of_word = np.repeat(np.array(owner, np.int64), np.diff(lists.offsets.to_numpy()))
        coded = lists.flatten().dictionary_encode()
        return of_word, coded.indices.to_numpy(), self.words(coded.dictionary)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of every text."""
        of_word, word, (_, _, sizes) = self._split(texts)
        return np.bincount(of_word, weights=sizes[word], minlength=len(texts)).astype(np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the ``len(texts) + 1`` places where each text begins."""
        of_word, word, (table, begins, sizes) = self._split(texts)
        long = sizes[word]
        per_text = np.bincount(of_word, weights=long, minlength=len(texts)).astype(np.int64)
        return gather(table, begins[word], long), np.concatenate(([0], np.cumsum(per_text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The encoder of this worker."""
    return WordEncoder(path)


def byte_batches(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about ``limit`` bytes together, one row at least."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, lo = np.cumsum(size.astype(np.int64)), 0
    while lo < batch.num_rows:
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts as strings, null as empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def release() -> None:
    """Give memory of freed batches back: workers outlive their tasks, and Arrow would keep it in every one of them."""
    pa.default_memory_pool().release_unused()
