import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from logvigil.llm import collocations as C
from logvigil.llm.collocations import collocations, phrase_graph, unary_paths
from logvigil.llm.scratch import Scratch

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def model(rows, top, min_count):
    """The contract by counting every phrase of one to three words."""
    counts = {}
    for text, lang in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for words in pieces_of(text):
            for k in (1, 2, 3):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: c for p, c in f.items() if len(p) > 1 and c >= min_count}
        found = []
        for p, a in often.items():
            if any(len(q) > len(p) and (q[:2] == p or q[1:] == p) and 100 * c >= 50 * a for q, c in often.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def random_rows(seed, n=60):
    draw = random.Random(seed)
    words = ["the", "The", "of", "a", "b", "É", "é", "x\xa0y", "z", "ü\x85", "\x1f"]
    gaps = [" ", " ", "  ", "\t", ". ", ", ", "\n", "?!", "\x0b", " ; "]
    rows = []
    for _ in range(n):
        text = "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randint(0, 80)))
        rows.append((text, draw.choice(["en", "de", None, "und", "", "x\ty z"])))
    return rows + [(None, "en"), ("", None), (" . , ", "de"), ("a b a b a b a b a b a b a b", "en"), ("one two three", "only")]


def frame(spark, rows):
    return spark.createDataFrame([(t, g, 1) for t, g in rows], "text string, lang string, n int").repartition(4)


@pytest.mark.parametrize("seed", range(3))
def test_phrases_against_counting(spark, seed):
    rows = random_rows(seed)
    got = collocations(frame(spark, rows), top=15, min_count=4)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == model(rows, 15, 4)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations(empty).count() == 0
    assert collocations(frame(spark, [(None, None), ("a", "en")])).count() == 0


def counted(rows, min_count):
    """All phrases of one to three words by language, by counting; rare words are left out."""
    f = Counter()
    for text, lang in rows:
        for words in pieces_of(text):
            for k in (1, 2, 3):
                f.update((lang, k, " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    return {p: n for p, n in f.items() if n >= min_count}


def graph_of(spark, rows, min_count=2):
    graph = phrase_graph(frame(spark, rows), Scratch(spark), min_count).where(f"phrase IS NOT NULL AND n >= {min_count}")
    return {(r.lang, r.words, r.phrase): r.n for r in graph.collect()}


@pytest.mark.parametrize("numbered", [None, 0, 1, 3])
def test_flows_and_piece_ends(spark, monkeypatch, numbered):
    """All words, none or some have numbers; languages likewise."""
    if numbered is not None:
        monkeypatch.setattr(C, "frequent_words", lambda docs: (["the", "a", "b"][:numbered], ["en", "und", "x\ty z"][:numbered]))
    rows = [(t, "und" if g is None else g) for t, g in random_rows(9)]
    assert graph_of(spark, rows) == counted(rows, 2)
    graph = phrase_graph(frame(spark, rows), Scratch(spark), 5)
    totals = {r.lang: r["sum(n)"] for r in graph.where("words = 1").groupBy("lang").agg({"n": "sum"}).collect()}
    words = Counter()
    for text, lang in rows:
        words[lang] += sum(map(len, pieces_of(text)))
    assert totals == {lang: n for lang, n in words.items() if n}


@pytest.mark.parametrize("numbered", [0, 2])
def test_phrases_do_not_depend_on_the_sample(spark, monkeypatch, numbered):
    monkeypatch.setattr(C, "frequent_words", lambda docs: (["of", "z"][:numbered], ["en", "de"][:numbered]))
    rows = random_rows(5)
    assert sorted(map(tuple, collocations(frame(spark, rows), top=15, min_count=4).collect())) == model(rows, 15, 4)


@pytest.mark.parametrize("begin", [0, 7, 30])
def test_slices_of_a_batch(begin):
    rows = [(t, g or "und") for t, g in random_rows(4)]
    texts, langs = pa.array([t for t, _ in rows]), pa.array([g for _, g in rows])
    none = pa.array([], pa.string())
    got = C.text_grams(texts.slice(begin, 20), langs.slice(begin, 20), none, none).to_pydict()
    want = Counter()
    for text, lang in rows[begin : begin + 20]:
        for words in pieces_of(text):
            want.update("0" + " ".join((*words, "", "")[i : i + 3]) + f"\t{lang}" for i in range(len(words)))
    assert dict(zip(got["gram"], got["n"])) == want and set(got["key"]) <= {None}


def test_grams_of_a_frequent_node_are_spread(spark):
    rows = spark.createDataFrame([(f"hot node w{k} and x. a b", "en") for k in range(400)], "text string, lang string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        grams = C.gram_counts(rows, ["hot", "node"] + [f"w{k}" for k in range(400)], ["en"])
        places = grams.where("key IS NOT NULL").selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
        sizes = [r["count"] for r in places]
        assert max(sizes) < 0.4 * sum(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_long_texts_are_cut_behind_pieces(spark, monkeypatch):
    text = "one two three four. five six, seven " * 40
    assert len(list(C._cut(text, 50))) > 5
    monkeypatch.setattr(C, "BATCH_BYTES", 50)
    rows = [(text, "en"), ("a b", "en")]
    assert graph_of(spark, rows, 1) == counted(rows, 1)


def test_exact_beyond_64_bits(spark):
    """Counts whose products pass 64 bits: the graph is given, not counted."""
    big = 6_000_000_000
    row = spark.sql(
        f"SELECT (1000000 * (CAST({big}L AS DECIMAL(19, 0)) * CAST({big}L AS DECIMAL(19, 0)))) div "
        f"(CAST({big + 7}L AS DECIMAL(19, 0)) * CAST({big + 5}L AS DECIMAL(19, 0))) AS score"
    ).first()
    assert row.score == 1_000_000 * big * big // ((big + 7) * (big + 5))


def model_paths(rows, min_count):
    """Edges joined over words pairs that all flow passes by one edge in and one edge out."""
    edges, starts, ends = Counter(), Counter(), Counter()
    for text, lang in rows:
        for words in pieces_of(text):
            if len(words) > 1:
                starts[tuple(words[:2])] += 1
                ends[tuple(words[-2:])] += 1
            edges.update(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    into, out = Counter(e[1:] for e in edges), Counter(e[:2] for e in edges)
    unary = {v for v in into if into[v] == 1 == out[v] and not starts[v] and not ends[v]}
    kept = {e: n for e, n in edges.items() if n >= min_count}
    after = {e[:2]: e for e in kept}
    paths = Counter()
    for e, n in kept.items():
        if e[:2] not in unary:
            words = list(e)
            while tuple(words[-2:]) in unary:
                words.append(after[tuple(words[-2:])][2])
            paths[" ".join(words), n] += 1
    return paths


def test_unary_paths(spark):
    draw = random.Random(1)
    text = "the quick brown fox jumps over the lazy dog and runs on to the far end of the field"
    rows = [(f"{draw.choice('uvw')} {text} {draw.choice('xyz')}. p q r s t", "en") for _ in range(12)] + [("lazy dog and cats", "en"), ("m n " * 9, "en")]
    scratch = Scratch(spark)
    graph = phrase_graph(frame(spark, rows), scratch, 3)
    got = Counter((r.phrase, r.n) for r in unary_paths(graph, scratch).collect())
    assert got == model_paths(rows, 3)
    assert any(len(phrase.split()) > 8 for phrase, _ in got)
