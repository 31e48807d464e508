import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from logvigil.llm import alignment
from logvigil.llm.alignment import PairEncoder, align_tokenizers, diagonal_runs, linked_pairs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "aAbé ßthe ing  \t\n\r\x0b\x1c\x85\xa0 　.,;'s!(){}<s>\x00▁漢字😀0192"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def random_texts(n, seed=7):
    draw = random.Random(seed)
    return ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 60))) for _ in range(n)]


def groups_of(text, libraries):
    """Groups of ids by the definition: byte places where tokens of both sides end."""
    a, b = libraries
    if not text:
        return []
    spelt = f" {text}".encode()
    ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    sizes_a = [len(x) for x in (bytes_of_a(a, i) for i in ids_a)]
    tokens_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b))]
    if sum(sizes_a) != len(spelt) or b"".join(tokens_b) != spelt:
        return []
    ends_a, ends_b = np.cumsum(sizes_a).tolist(), np.cumsum([len(t) for t in tokens_b]).tolist()
    shared = sorted(set(ends_a) & set(ends_b))
    groups = [([], []) for _ in shared]
    for side, (ids, ends) in enumerate(((ids_a, ends_a), (ids_b, ends_b))):
        for i, e in zip(ids, ends):
            groups[bisect_left(shared, e)][side].append(i)
    return groups


def bytes_of_a(a, i, seen={}):
    # the length in bytes of a byte-level token is its length in characters
    return a.id_to_token(i)


def model(rows, libraries):
    """The contract's columns of ``(doc_id, text)`` rows."""
    held, counts = [], Counter()
    for i, text in rows:
        groups = groups_of(text, libraries)
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        counts.update(links.keys())
        held.append((i, groups, links))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for i, groups, links in held:
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((
            i, sum(len(xs) for xs, _ in groups), sum(len(ys) for _, ys in groups), len(groups), links.total(),
            sum(n for pair, n in links.items() if counts[pair] == top[pair[0]]), sum(n * counts[pair] for pair, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in row)


def test_chunks_encode_as_whole_texts(libraries):
    texts = random_texts(3000)
    (ids_a, ids_b), (n_a, n_b), _ = PairEncoder(A, B).encode(texts)
    at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    for k, text in enumerate(texts):
        groups = groups_of(text, libraries)
        assert ids_a[at_a[k] : at_a[k] + n_a[k]].tolist() == [i for xs, _ in groups for i in xs]
        assert ids_b[at_b[k] : at_b[k] + n_b[k]].tolist() == [i for _, ys in groups for i in ys]


def test_byte_level_alphabet(libraries):
    coder, (a, _) = PairEncoder(A, B), libraries
    for i in range(0, a.get_vocab_size(), 97):
        shown = coder.bytes_a[i].decode(errors="replace")
        assert shown == ByteLevel().decode([a.id_to_token(i)])


@pytest.mark.parametrize("seed", range(5))
def test_runs_meet_where_both_end(seed):
    draw = np.random.default_rng(seed)
    total = 4000
    shared = np.sort(draw.choice(np.arange(1, total), 900, replace=False))
    sides = [np.unique(np.concatenate((shared, draw.choice(np.arange(1, total), n), [total]))) for n in (40, 400)]
    common = np.intersect1d(*sides)
    for every in (1, 7, 10_000):
        cuts = np.concatenate((common[every - 1 :: every], [total]))
        cuts = np.unique(np.append(cuts, total))
        places = [np.concatenate(([0], np.searchsorted(s, cuts) + 1)) for s in sides]
        ends = diagonal_runs(*sides, *places)
        for side, end in zip(sides, ends):
            assert side[end - 1].tolist() == common.tolist()


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    ids_a, ids_b = np.array([1, 2, 1, 3]), np.array([5, 5, 6])
    ends, owner = (np.array([3, 4]), np.array([2, 3])), np.array([0, 1])
    plain = linked_pairs(ids_a, ids_b, *ends, owner, (10, 10))
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 1)
    for x, y in zip(plain, linked_pairs(ids_a, ids_b, *ends, owner, (10, 10))):
        assert x.tolist() == y.tolist()
    assert dict(zip(plain[1].tolist(), plain[2].tolist())) == {15: 4, 25: 2, 36: 1}


@pytest.mark.parametrize("head", [alignment.HEAD_PAIRS, 20])
def test_rows_against_the_definition(spark, libraries, monkeypatch, head):
    monkeypatch.setattr(alignment, "HEAD_PAIRS", head)  # 20: most pairs come back by the shuffle
    rows = [(k, text) for k, text in enumerate(random_texts(150, 3))]
    rows += [(3, "once more"), (3, "once more"), (None, "no id"), (None, None), (900, None), (901, ""), (902, "▁ in the text"), (903, "a " * 30_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, n_a string").repartition(3)
    got = align_tokenizers(docs, A, B)
    assert got.columns == COLUMNS
    assert sorted(map(key, got.collect())) == sorted(map(key, model(rows, libraries)))


def test_empty_table(spark):
    assert align_tokenizers(spark.createDataFrame([], "doc_id bigint, text string"), A, B).count() == 0
