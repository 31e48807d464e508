import hashlib
import random
import re
import tempfile
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from logvigil.llm.components import components
from logvigil.llm.decontaminate import contamination, decontaminate, unsought
from logvigil.llm.near_dedup import Postings, near_duplicates, probability_jaccard, shingles, signatures
from logvigil.llm.scratch import CLEANUP, Scratch
from logvigil.llm.substrings import anchors, remove_repeats

DOC = "doc_id bigint, text string, class_id string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(n, seed, vocabulary=5000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def plain_jaccard(a, b):
    wa, wb = dict(zip(*map(list, a), strict=True)), dict(zip(*map(list, b), strict=True))
    every = set(wa) | set(wb)
    return sum(1 / sum(max(wa.get(e, 0) / wa[d], wb.get(e, 0) / wb[d]) for e in every) for d in set(wa) & set(wb))


@pytest.mark.parametrize("seed", range(8))
def test_probability_jaccard(seed):
    draw = np.random.default_rng(seed)
    a = (np.unique(draw.integers(0, 30, 15)).astype(np.uint64),) * 1
    a = (a[0], draw.integers(1, 4, len(a[0])))
    b0 = np.unique(draw.integers(0, 30, 15)).astype(np.uint64)
    b = (b0, draw.integers(1, 4, len(b0)))
    assert probability_jaccard(a, b) == pytest.approx(plain_jaccard(a, b))


def test_signatures_estimate():
    hashes = np.random.default_rng(1).integers(0, 2**63, 400).astype(np.uint64)
    a, b = shingles(hashes), shingles(np.r_[hashes[:360], hashes[:7]])
    table = signatures([a, b], 2000)
    assert abs((table[0] == table[1]).mean() - probability_jaccard(a, b)) < 0.05


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    roots = {r.node: r.root for r in components(links).collect()}
    assert roots == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_near_duplicates_against_all_pairs(spark):
    draw, rows, base = random.Random(9), [], words(150, 1)
    for i in range(60):  # copies of one text with a few words changed each: a chain of links around the threshold
        text = list(base)
        for _ in range(draw.randrange(6)):
            text[draw.randrange(150)] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(text), "x"))
    rows += [(100 + i, " ".join(words(80, 50 + i)), None) for i in range(30)]
    rows += [(200, rows[0][1].upper(), "x"), (201, "  ".join(words(80, 50)), "x"), (202, "one two", "x"), (203, "one two", "x")]
    rows += [(204, None, "x"), (205, "", "x"), (206, " \n", "x"), (None, "one two", "x"), (0, rows[0][1], "x"), (207, "a " * 30000, "x")]
    got = near_duplicates(spark.createDataFrame(rows, DOC).repartition(4)).collect()
    assert len(got) == len(rows)
    known, texts = {}, {i: t for i, t, _ in rows if i is not None and (t or "").split()}
    for i, t in texts.items():
        hashes = np.array([int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in t.lower().split()], np.uint64)
        known[i] = shingles(hashes)
    root = {i: i for i in texts}

    def find(x):
        return x if root[x] == x else find(root[x])

    held = Postings([known[i] for i in texts])
    ids = list(texts)
    for k, i in enumerate(ids):
        for at in held.similar(known[i], 0.8)[0]:
            a, b = find(i), find(ids[at])
            root[max(a, b)] = min(a, b)
    want = {i: find(i) for i in texts} | {204: 204, 205: 205, 206: 206}
    for r in got:
        assert r.class_id == (want[r.doc_id] if r.doc_id is not None else 202)
    assert near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_anchor_depends_on_the_window_alone():
    draw = np.random.default_rng(4)
    for _ in range(30):
        inner = draw.integers(0, 4, 13).astype(np.uint64)  # few words, so runs are common
        seen = set()
        for _ in range(5):
            left, right = (draw.integers(0, 4, draw.integers(0, 20)).astype(np.uint64) for _ in range(2))
            word = np.concatenate([left, inner, right])
            seen.add(int(anchors(word, np.zeros(len(word), np.int64))[len(left)]))
        assert len(seen) == 1


def plain_removal(rows):
    first, out = {}, {}
    for i, text in sorted(rows):
        word = WORD.findall(text or "")
        gone = [False] * len(word)
        for k in range(len(word) - 12):
            if first.setdefault(tuple(word[k : k + 13]), i) != i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(w for w, g in zip(word, gone, strict=True) if not g)
        out[i] = (len(word), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("vocabulary", [2, 5000])
def test_repeats_against_all_windows(spark, vocabulary):
    draw, rows = random.Random(vocabulary), []
    passages = [words(n, n, vocabulary) for n in (13, 14, 30, 60)]
    for i in range(60):
        parts = [words(draw.randrange(30), 1000 + i, vocabulary)]
        for _ in range(draw.randrange(3)):
            parts += [draw.choice(passages), words(draw.randrange(20), draw.randrange(10**6), vocabulary)]
        rows.append((i, " \t".join(sum(parts, []))))
    rows += [(70, None), (71, ""), (72, rows[3][1]), (73, rows[3][1] + " "), (74, "z " * 5000), (75, "z " * 40)]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], DOC).repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(table).collect()}
    assert got == plain_removal(rows)
    assert remove_repeats(table.where("false")).count() == 0


def test_repeats_read_the_texts_once_for_the_result(spark, tmp_path, capsys):
    rows = [(i, " ".join(words(40, i % 3)), "x") for i in range(6)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents"))
    out = remove_repeats(spark.read.parquet(str(tmp_path / "documents")))
    capsys.readouterr()
    out.explain()
    assert capsys.readouterr().out.count("ReadSchema: struct<doc_id:bigint,text:string>") == 1
    assert sorted(r.n_removed for r in out.collect()) == [0, 0, 0, 40, 40, 40]


def test_staging_leaves_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(Scratch, "_collect", lambda self: None)  # as where the driver's garbage is collected too early
    folder = Path(spark.conf.get("spark.local.dir", tempfile.gettempdir()))

    def files():
        return {*folder.glob("blockmgr-*/*/shuffle_*.data")}

    old, kept = files(), spark.conf.get(CLEANUP)
    scratch = Scratch(spark)
    held = scratch.stage(spark.range(10000).groupBy((F.col("id") % 100).alias("k")).count(), "counted")
    until = time.time() + 20
    while files() - old and time.time() < until:
        time.sleep(0.1)
    assert not files() - old
    assert held.count() == 100
    assert spark.conf.get(CLEANUP) == kept


def test_repeats_of_rows_with_equal_ids(spark):
    a, b, c = words(40, 501), words(45, 502), words(30, 503)
    rows = [
        (1, a), (5, a), (5, b), (5, b), (5, c + a[5:25]), (5, a[:14]), (5, words(3, 504)), (6, b[10:30] + c), (7, words(20, 505) + c), (7, b), (7, None),
    ]
    lowest = {}
    for i, word in sorted(rows, key=lambda r: r[0]):
        for k in range(len(word or []) - 12):
            lowest.setdefault(tuple(word[k : k + 13]), i)
    want = []
    for i, word in rows:
        word = word or []
        under = {k + j for k in range(len(word) - 12) if lowest[tuple(word[k : k + 13])] < i for j in range(13)}
        kept = " ".join(w for k, w in enumerate(word) if k not in under)
        want.append((i, len(word), len(under), hashlib.sha256(kept.encode()).hexdigest()))
    table = spark.createDataFrame([(i, None if w is None else " ".join(w), "x") for i, w in rows], DOC).repartition(4)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(table).collect()]
    assert sorted(got) == sorted(want)


def test_contamination(spark):
    item, short = words(30, 77), words(7, 78)
    changed = list(item)
    changed[4] = changed[10] = "other"
    few = list(item[:13])
    few[0] = few[5] = few[9] = "other"
    rows = [
        (1, " ".join(words(50, 1) + item + words(9, 2))), (2, " ".join(changed).upper()), (3, " ".join(words(20, 3) + item[9:22])),
        (4, " ".join(words(40, 4))), (5, " ".join(["a", *short, "b"])), (6, " ".join(["a", *short[:6], "b"])), (7, None), (8, ""),
        (9, " ".join(words(20, 9) + few + words(20, 10))), (1, " ".join(item)), (None, " ".join(item)), (10, " ".join(item[:12])),
    ]
    bench = spark.createDataFrame([(5, " ".join(item)), (6, " ".join(short)), (7, None), (8, "one two"), (None, "x")], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], DOC)
    got = sorted((r.doc_id, r.item_id, r.matched, r.item_words) for r in contamination(docs, bench).collect())
    assert got == [(1, 5, 30, 30), (2, 5, 28, 30), (3, 5, 13, 30), (5, 6, 7, 7)]
    kept = [r.doc_id for r in decontaminate(docs, bench).collect()]
    assert sorted(kept, key=str) == sorted([4, 6, 7, 8, 9, 10, None], key=str)
    assert contamination(docs.where("false"), bench).count() == contamination(docs, bench.where("false")).count() == 0


def test_contamination_by_short_items(spark):
    items = {n: words(n, 600 + n) for n in range(1, 14)}
    rows, want = [], []
    for n, item in items.items():
        for places in [(), *[(k,) for k in range(n)], (0, n - 1)]:
            text = words(20, 700 + len(rows)) + ["other" if k in places else w for k, w in enumerate(item)] + words(9, 900 + len(rows))
            allowed = 2 if n >= 13 else 1 if n >= 8 else 0
            if n >= 5 and len(set(places)) <= allowed:
                want.append((len(rows), n, 20, n - len(set(places)), n))
            rows.append((len(rows), " ".join(text), "x"))
        for edge in (item[1:], item[:-1]):  # a word that is missing is no substitution
            rows.append((len(rows), " ".join(edge), "x"))
    bench = spark.createDataFrame([*[(n, " ".join(w)) for n, w in items.items()], (20, None)], "item_id bigint, text string")
    got = contamination(spark.createDataFrame(rows, DOC), bench).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sorted(map(tuple, unsought(bench).collect())) == [(1, 1), (2, 2), (3, 3), (4, 4), (20, 0)]
