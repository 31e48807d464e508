import hashlib
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from logvigil.llm.neighbours import chi_square_cdf, chi_square_quantile, nearest
from logvigil.llm.quality import BUCKETS, Model, fit, ngrams, packed, score_documents, train, unpacked
from logvigil.llm.queries import ORACLES, QUERIES
from logvigil.llm.secrets import redact_secrets, scan_secrets, secret_spans
from logvigil.llm.warc import round_trip

SF_DIR = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, spans string"


def test_chi_square():
    assert chi_square_cdf(2 * np.log(2), 2) == pytest.approx(0.5)
    assert chi_square_quantile(0.95, 12) == pytest.approx(21.026, abs=1e-3)


def test_nearest(spark):
    draw = np.random.default_rng(2)
    centers = draw.standard_normal((20, 16))
    vec = (centers[draw.integers(0, 20, 1500)] + 0.3 * draw.standard_normal((1500, 16))).astype(np.float32)
    vec[40:60] = vec[40]  # ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vec)]
    rows += [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] * 16, 0), (2080, [1.0], 0), (None, [1.0] * 16, 0)]
    got = nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")).toPandas()
    right = total = 0
    wide = vec.astype(np.float64)
    for q in range(0, 1500, 20):
        part = got[got.query_id == q].sort_values("rank")
        score = wide @ wide[q]
        best = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        assert part["rank"].tolist() == list(range(1, 21)) and q not in part.vec_id.tolist()
        assert np.allclose(part.score, score[part.vec_id])
        assert part.apply(lambda r: (-r.score, r.vec_id), axis=1).is_monotonic_increasing
        right, total = right + len({*best} & {*part.vec_id}), total + 20
    assert len(got) == total and right / total >= 0.95
    assert nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<double>")).count() == 1
    assert nearest(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0


def test_buckets_travel_as_a_byte_each():
    cases = [[], [0], [BUCKETS - 1], [0, 1, 254, 255, 256, 510, 765, 1020, BUCKETS - 1], list(range(BUCKETS))]
    for buckets in cases:
        assert unpacked(packed(np.array(buckets, np.int64))).tolist() == buckets
    text = " ".join(f"w{n * 7919 % 5003}" for n in range(600))
    buckets = ngrams(text)
    assert unpacked(packed(buckets)).tolist() == buckets.tolist()
    assert len(packed(buckets)) <= len(buckets) + BUCKETS // 255  # the fit holds the sample in one task


def test_quality(spark):
    draw = np.random.default_rng(3)
    word = lambda: "".join(draw.choice(list("abcdefgh"), draw.integers(2, 7)))
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        rows.append((i, " ".join(word() + ("" if good else "***") for _ in range(30)), "x"))
        labels.append((i, int(good), "y"))
    rows += [(500, None, "x"), (501, "", "x"), (None, "abc", "x"), (502, "a*** " * 20000, "x")]
    docs = spark.createDataFrame(rows, DOC)
    model = train(docs, spark.createDataFrame([*labels, (None, 1, ""), (3, None, "")], "doc_id bigint, quality int, text string"))
    got = score_documents(docs, model).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    known = got[got.doc_id < 400]
    held = known[known.held_out]
    assert 40 < len(held) < 120 and (held.predicted == (held.doc_id % 4 != 0)).mean() > 0.97
    assert got[got.doc_id == 502].predicted.item() == 0
    empty = train(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert empty.score(ngrams("abc")) == pytest.approx(0.5)
    assert isinstance(fit([ngrams("a b")] * 3, np.ones(3, int)), Model)


def test_secrets(spark):
    key = "aB3" + "x" * 37
    rows = [
        (1, "é password: hunter2hunter2 end AKIA" + "A" * 16 + " " + "0a" * 16), (2, None), (3, ""), (4, "token=secret: abcdefgh12 " + key),
        (5, "AKIA" + "B" * 16 + " " + key + " https://db.example.org/x"), (6, "see https://db.example.org/x"), (5, "AKIA" + "B" * 16),
        (7, "user=bob " + "." * 300 + " " + key), (8, "user=bob " + key), (None, "api-key=1 apikey = 'abcdefgh'"), (9, "PassWD=12345678 " * 3000),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], DOC)
    got = {(r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in scan_secrets(docs).collect()}
    pattern = [
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        re.compile("AKIA[A-Z0-9]+"),
        re.compile("[0-9a-f]+"),
    ]
    want = set()
    for i, t in rows:
        found = [(m.start(), k, m.end()) for k, p in enumerate(pattern) for m in p.finditer(t or "")
                 if len(m.group(2) if k == 0 else m.group()) >= (8, 16, 32)[k]]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        want.add((i, hashlib.sha256(text.encode()).hexdigest(), *[sum(f[1] == k for f in found) for k in range(3)]))
    assert got == want
    spans = {r.doc_id: r.spans for r in scan_secrets(docs.where("doc_id <> 5 OR length(text) > 30")).collect()}
    assert spans[5] == "access:0:20,key:21:61,endpoint:62:86" and spans[6] == "" and spans[7] == ""
    assert spans[8] == "account:0:8,key:9:49" and spans[4].startswith("assign:0:12") is False
    clean = {r.doc_id: r.text for r in redact_secrets(docs).where("doc_id <> 5").collect()}
    assert clean[8] == "[SECRET] [SECRET]" and clean[6] == rows[5][1] and clean[2] is None
    assert clean[1] == "é [SECRET] end [SECRET] [SECRET]"
    assert scan_secrets(redact_secrets(docs)).where("n_assign + n_access + n_hex > 0").count() == 0
    assert secret_spans(docs.where("false")).count() == 0


def test_warc(spark):
    magic = "WARC/1.1\r\n"
    rows = [
        (9, "u x", "a" * 200), (8, "u", "a" * 200), (10, None, "a" * 200), (11, "u", "x"), (12, "u", "x"), (13, "u", None),
        (14, "é\r\nü", f"pre {magic}WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n{magic}" * 9), (15, "u", magic),
        (None, "u", "a" * 200), (16, "u", "\r\n\r\n" * 50), (17, "u", "ß" * 300000), (18, "v", f"{magic}Content-Length: 0\r\n\r\n\r\n\r\n"),
        (18, "v", f"{magic}Content-Length: 0\r\n\r\n\r\n\r\n"),
    ]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # archives in many splits
    got = round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first, want = {}, []
    for i, _, body in rows:
        if i is not None:
            first[body or ""] = min(first.get(body or "", i), i)
    for i, _, body in rows:
        data, low = (body or "").encode(), first[body or ""]
        again = len(data) >= 100 and low != i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", low if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="tables not present")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, SF_DIR)
    want = con.sql(ORACLES[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


@pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="tables not present")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    strange = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (None, "some words", None, None, 1)], docs.schema)
    docs = docs.unionByName(strange).unionByName(docs.limit(3))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.schema.simpleString() == docs.schema.simpleString() and 0 < out.count() <= docs.count()
        docs = spark.createDataFrame(out.collect(), docs.schema)
    texts = [r.text for r in docs.collect()]
    assert len([t for t in texts if t]) == len({t for t in texts if t})
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF_DIR).count() == 0
