import hashlib
import random
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from logvigil.llm.near_dedup import probability_jaccard, shingles
from logvigil.llm.quality import THRESHOLD, ngrams, train
from logvigil.llm.queries import PACK_END, TOKENIZER

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SECRET = re.compile(r"password=[A-Za-z0-9]{8,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}")  # what the fixture holds


def prose(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices("ghijklmnop", k=draw.randrange(3, 8))) for _ in range(n)]


def fixture():
    """Texts by id, labels by id, and benchmark items."""
    texts, labels = {}, {}
    for i in range(120):
        good = i % 4 != 0
        texts[i] = [w if good else w + "***" for w in prose(60, i)]
        labels[i] = int(good)
    for k, i in enumerate((1, 2, 3, 5)):  # near and exact copies
        texts[200 + k] = [*texts[i][:-1], *(["changed"] if k % 2 else texts[i][-1:])]
    long, short = prose(30, 900), prose(9, 901)
    texts[300] = prose(20, 902) + long[5:25] + prose(20, 903)
    texts[301] = prose(20, 904) + short[:4] + ["other"] + short[5:] + prose(20, 905)
    texts[302] = prose(20, 906) + short[:7] + prose(20, 907)  # two words are missing: no leak
    for k, secret in enumerate(("password=hunter2hunter2", "AKIA" + "Z" * 16, "0a" * 16)):
        texts[400 + k] = [*prose(30, 910 + k), secret, *prose(30, 920 + k)]
    texts[500] = prose(3000, 930)
    texts = {i: " ".join(t) for i, t in texts.items()} | {501: "", 502: None}
    return texts, labels, {1: long, 2: short}


def classes(texts):
    """The smallest id of each document's class, over all pairs."""
    known = {
        i: shingles(np.array([int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in t.lower().split()], np.uint64))
        for i, t in texts.items() if t
    }
    root = {i: i for i in texts}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in known:
        for b in known:
            if a < b and probability_jaccard(known[a], known[b]) >= 0.8 - 1e-9:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in texts}


def leaks(text, item):
    """Whether 13 words of the item, or all of a shorter one, stand in the text with as many changes as are allowed."""
    word, size = (text or "").lower().split(), min(13, len(item))
    allowed = 2 if len(item) >= 13 else 1 if len(item) >= 8 else 0
    return any(
        sum(a != b for a, b in zip(word[p : p + size], item[k : k + size], strict=True)) <= allowed
        for p in range(len(word) - size + 1) for k in range(len(item) - size + 1)
    )


def test_run_against_a_plain_model(spark, tmp_path):
    texts, labels, items = fixture()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    tables = {
        "documents": spark.createDataFrame(rows, DOCS).repartition(3),
        "labels": spark.createDataFrame(list(labels.items()), "doc_id bigint, quality int"),
        "benchmark": spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    model = train(tables["documents"], tables["labels"], "quality")
    kept = {i: t for i, t in texts.items() if model.score(ngrams(t or "")) >= THRESHOLD}
    assert {i for i in range(120) if i % 4 == 0}.isdisjoint(kept) and len(kept) > 90
    root = classes(kept)
    kept = {i: t for i, t in kept.items() if root[i] == i}
    assert not {200, 201, 202, 203} & set(kept)
    kept = {i: t for i, t in kept.items() if not any(leaks(t, item) for item in items.values())}
    assert not {300, 301} & set(kept) and {302, 400, 401, 402, 500} <= set(kept)
    kept = {i: SECRET.sub("[SECRET]", t or "") for i, t in kept.items()}

    library = Tokenizer.from_file(TOKENIZER)
    assert set(got.doc_id) == set(kept)
    for i, part in got.groupby("doc_id"):
        ids = np.array([*library.encode(kept[i], add_special_tokens=False).ids, PACK_END], "<u4")
        at = 0
        for piece in part.sort_values("start").itertuples():
            assert piece.start == at and piece.doc_tokens == len(ids)
            assert piece.ids_crc32 == zlib.crc32(ids[at : at + piece.length].tobytes())
            at += piece.length
        assert at == len(ids)
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.length.sum() <= 2048 and (part.offset == part.length.cumsum() - part.length).all()
