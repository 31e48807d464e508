import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logvigil.llm import encoding
from logvigil.llm.encoding import WordEncoder, cut_at_blanks, gather
from logvigil.llm.packing import cut_points, pack, pack_documents, place
from logvigil.llm.token_counts import token_counts
from logvigil.llm.token_files import read_token_files, token_digests, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [
    (3, "Hello, world! it's", "x"), (1, None, "y"), (2, "", None), (None, "a b", "z"), (3, "Hello, world! it's", "x"),
    (7, "word " * 9000, "x"), (8, "<|endoftext|> café ÉCOLE 12 ΣΑΣ", "x"), (9, " \t\n", "x"), (10, "a" * 5000, "x"),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, n_tokens string").repartition(3)


def test_words_encode_as_whole_texts(library):
    draw = random.Random(5)
    letters = "aAbéÉñßÿ÷×'sSdtrvemlL019²<|>startoftext !.,$Σςİıﬁ́  \t\n\x1c\x85漢字"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    ids, begins = WordEncoder(PATH).ids(texts)
    for k, one in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert one.ids == ids[begins[k] : begins[k + 1]].tolist()


def test_cut_at_blanks():
    text = "ab cd\tef  gh"
    pieces = cut_at_blanks(text, 3)
    assert "".join(pieces) == text and all(not p or p[0] in " \t\n" for p in pieces[1:])


def test_counts(spark, docs, library):
    got = sorted(tuple(r) for r in token_counts(docs, PATH).where("doc_id IS NOT NULL").collect())
    want = []
    for i, text, _ in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        if i is not None:
            want.append((i, len((text or "").encode()), n, n > 2048))
    assert got == sorted(want)
    assert token_counts(docs.where("false"), PATH).count() == 0


def test_files_round_trip(spark, docs, library, tmp_path):
    write_token_files(docs.where("doc_id IS NOT NULL"), str(tmp_path / "t"), PATH, 2)
    got = sorted(tuple(r) for r in token_digests(spark, str(tmp_path / "t")).collect())
    want, at = [], 0
    for i, text, _ in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert read_token_files(spark, str(tmp_path / "t")).where("doc_id = 1").first()["ids"] == [2]


def test_words_encode_in_blocks(library, monkeypatch):
    monkeypatch.setattr(encoding, "BLOCK_WORDS", 7)
    monkeypatch.setattr(encoding, "GATHER_RUNS", 5)
    monkeypatch.setattr(encoding, "CACHE_PARTS", 20)
    texts = [" ".join(f"w{'abc'[k % 3] * (k % 11)}{k * n} É{k} Σ{n}" for k in range(40)) for n in range(5)] + ["", " "]
    ids, begins = WordEncoder(PATH).ids(texts)
    for k, one in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert one.ids == ids[begins[k] : begins[k + 1]].tolist()


def test_gather_takes_little_more_than_its_result():
    table, sizes = np.arange(100, dtype=np.int32), np.arange(1_500_000) % 4
    begins = np.arange(len(sizes)) % 97
    tracemalloc.start()
    got = gather(table, begins, sizes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < got.nbytes + sizes.nbytes + (8 << 20)
    assert got.tolist() == [b + k for b, n in zip(begins.tolist(), sizes.tolist()) for k in range(n)]


def test_digests_read_the_ids_once(spark, docs, tmp_path):
    write_token_files(docs, str(tmp_path / "t"), PATH, 2)
    digests = token_digests(spark, str(tmp_path / "t"))
    assert digests._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert digests.count() == len(ROWS)
    read_token_files(spark, str(tmp_path / "t")).withColumn("n_tokens", F.col("n_tokens") + 1).write.parquet(str(tmp_path / "wrong"))
    with pytest.raises(Exception, match="n_tokens differs"):
        token_digests(spark, str(tmp_path / "wrong")).collect()


def test_cut_points():
    for n in (1, 127, 128, 129, 300, 2047, 2048, 2049, 5000):
        cuts = cut_points(n)
        assert cuts[0] == 0 and cuts[-1] == n and all(0 < b - a <= 2048 for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def test_place_keeps_all_limits():
    draw = np.random.default_rng(3)
    demand = np.column_stack([draw.integers(1, 2049, 400), np.ones(400), draw.integers(0, 900, 400)]).astype(float)
    limits = np.array([2048.0, 4, 1200])
    bins, order = place(demand, limits)
    for b in range(bins.max() + 1):
        assert (demand[bins == b].sum(axis=0) <= limits).all()
        assert sorted(order[bins == b]) == list(range((bins == b).sum()))


def test_packing_covers_every_id(spark, docs, library):
    rows = pack_documents(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), PATH, 1).toPandas()
    texts = {i: t for i, t, _ in ROWS if i is not None}
    for i, part in rows.groupby("doc_id"):
        ids = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for piece in part.sort_values("start").itertuples():
            assert piece.start == at and piece.doc_tokens == len(ids)
            assert piece.ids_crc32 == zlib.crc32(ids[at : at + piece.length].tobytes())
            at += piece.length
        assert at == len(ids)
    for _, part in rows.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.length.sum() <= 2048 and (part.offset == part.length.cumsum() - part.length).all()


def test_pack_of_nothing(spark):
    empty = spark.createDataFrame([], "k bigint, n bigint")
    assert pack(empty, {"n": 10}, "n", ["k"]).count() == 0
