"""Near-duplicate classes by ProbMinHash signatures, banding, verification and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.llm.components import components
from logvigil.llm.encoding import release
from logvigil.llm.words import word_hashes
from logvigil.llm.scratch import Scratch

WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 24, 4  # a pair at 0.8 shares no band with probability 0.5904^24, 3 in a million
REGISTERS = BANDS * BAND_ROWS
CENTERS = 2
ESTIMATE_SLACK = 0.18  # pairs whose estimate is this far below the threshold (over four standard errors) are not verified
BLOCK_ROWS, BLOCK_WORDS = 512, 500_000
SLICE_WORDS = 200_000  # words that are signed at once, one text at least
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0xD1342543DE82EF95, k, 1 << 64) for k in range(64)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers (the finalizer of a well-known generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``words`` words and how often each occurs; a shorter text is one shingle."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    width = min(words, n)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += hashes[k : n - width + 1 + k] * _POWERS[k]
    return np.unique(mix(total + np.uint64(width)), return_counts=True)


def signatures(docs: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures, a row per document of distinct elements and their weights.

    Every element sends a Poisson process of arrivals at the rate of its weight; each arrival hits a random register, and a register
    keeps the element that came first. Equal registers of two documents have the probability of their probability Jaccard.
    An element's arrivals end early once the next one is later than the latest register. All documents advance together, one
    arrival of every live element a round.
    """
    sizes = np.array([len(e) for e, _ in docs], np.int64)
    element = np.concatenate([e for e, _ in docs]) if docs else np.empty(0, np.uint64)
    rate = np.concatenate([w for _, w in docs]).astype(np.float64) if docs else np.empty(0)
    owner = np.repeat(np.arange(len(docs)), sizes)
    first = np.full(len(docs) * registers, np.inf)
    winner = np.zeros(len(docs) * registers, np.uint64)
    time, state = np.zeros(len(element)), element.copy()
    while len(element):
        state = mix(state + _MULTIPLIER)
        time = time - np.log((((state >> np.uint64(11)).astype(np.float64)) + 0.5) * 2.0**-53) / rate
        state = state + _MULTIPLIER
        slot = owner * registers + (mix(state) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        winner[slot[won]] = element[won]
        live = time < first.reshape(-1, registers).max(axis=1)[owner]
        element, rate, owner, time, state = element[live], rate[live], owner[live], time[live], state[live]
    return winner.reshape(-1, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common elements of 1 / sum of the larger relative weight: order by weight ratio, then running sums."""
    union = np.union1d(a[0], b[0])
    wa, wb = np.zeros(len(union)), np.zeros(len(union))
    wa[np.searchsorted(union, a[0])] = a[1]
    wb[np.searchsorted(union, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = wa / wb
    order = np.argsort(ratio, kind="stable")
    ratio, wa, wb = ratio[order], wa[order], wb[order]
    low = np.cumsum(wb)
    high = wa.sum() - np.cumsum(wa)
    last = np.searchsorted(ratio, ratio, side="right") - 1  # equal ratios give the same larger weight either way
    both = (wa > 0) & (wb > 0)
    return float((1 / (high[last][both] / wa[both] + low[last][both] / wb[both])).sum())


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [values[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band = np.arange(BANDS, dtype=np.uint64)
    for whole in batches:
        total = np.r_[0, np.cumsum([len(h) for h in _lists(whole.column("hashes"))])]
        # about as many words a slice, whatever the lengths; a longer text is a slice of its own
        cuts = np.flatnonzero(np.diff(total[1:] // SLICE_WORDS, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], whole.num_rows], strict=False):  # a batch without rows has no cuts
            batch = whole.slice(lo, hi - lo)
            table = signatures([shingles(h) for h in _lists(batch.column("hashes"))])
            keys = np.tile(band, (len(table), 1))
            for k in range(BAND_ROWS):
                keys = mix(keys * _MULTIPLIER + table[:, k::BAND_ROWS][:, :BANDS])
            short = np.ascontiguousarray(table & np.uint64(0xFFFFFFFF)).astype("<u4")
            rows = np.arange(len(table) + 1, dtype=np.int32) * BANDS
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "k1", "k2")],
                    pa.ListArray.from_arrays(pa.array(rows), pa.array(keys.ravel().view(np.int64))),
                    pa.array([r.tobytes() for r in short], pa.binary()),
                ],
                ["doc_id", "k1", "k2", "bands", "signature"],
            )
        release()


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = _lists(batch.column("ha")), _lists(batch.column("hb"))
        value = [probability_jaccard(shingles(x), shingles(y)) for x, y in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(value, pa.float64())], ["a", "b", "similarity"])


class Postings:
    """Texts by shingle, to find all that are similar to one text without going through pairs."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]]):
        self.texts, self.n = texts, len(texts)
        element = np.concatenate([e for e, _ in texts]) if texts else np.empty(0, np.uint64)
        self.total = np.array([w.sum() for _, w in texts], np.float64)
        self.plain = np.array([(w == 1).all() for _, w in texts], bool)
        share = np.concatenate([w / w.sum() for _, w in texts]) if texts else np.empty(0)
        owner = np.repeat(np.arange(self.n), [len(e) for e, _ in texts])
        order = np.argsort(element, kind="stable")
        self.element, self.owner, self.share = element[order], owner[order], share[order]

    def similar(self, text: tuple[np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the texts that reach ``least``.

        Texts without repeated shingles need the size of the overlap only. For others the common share of either text's
        weight bounds the similarity, and what passes is computed in full.
        """
        low, high = (np.searchsorted(self.element, text[0], side=side) for side in ("left", "right"))
        size = high - low
        places = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
        who = self.owner[places]
        own = np.bincount(who, weights=np.repeat(text[1] / text[1].sum(), size), minlength=self.n)
        theirs = np.bincount(who, weights=self.share[places], minlength=self.n)
        at = np.flatnonzero(np.minimum(own, theirs) >= least - 1e-9)
        value = np.empty(len(at))
        plain = self.plain[at] & bool((text[1] == 1).all())
        common = own[at[plain]] * text[1].sum()
        value[plain] = common / (text[1].sum() + self.total[at[plain]] - common)
        value[~plain] = [probability_jaccard(text, self.texts[k]) for k in at[~plain]]
        keep = value >= least - 1e-9
        return at[keep], value[keep]


def _apart(similarity: float):
    """Links between texts of different classes in two blocks of one bucket; ``ask`` marks texts outside the bucket's largest class."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(text=[shingles(np.asarray(h, np.int64).view(np.uint64)) for h in rows["hashes"]])
        one, two = (rows[rows["block"] == rows[c].iat[0]] for c in ("low", "high"))
        tasks = [(one[one["ask"]], two)]
        if rows["low"].iat[0] != rows["high"].iat[0]:
            tasks.append((two[two["ask"]], one[~one["ask"]]))
        out = []
        for asking, held in tasks:
            if not len(asking):
                continue
            postings, ids, root = Postings(held["text"].tolist()), held["doc_id"].to_numpy(np.int64), held["root"].to_numpy(np.int64)
            for own, own_root, text in zip(asking["doc_id"], asking["root"], asking["text"], strict=True):
                at, value = postings.similar(text, similarity)
                apart = root[at] != own_root
                at, value = at[apart], value[apart]
                out.append(pd.DataFrame({"a": np.maximum(ids[at], own), "b": np.minimum(ids[at], own), "similarity": value}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "similarity": []})

    return compare


def _likely(least: float):
    """Pairs whose signatures agree in a share of ``least`` registers."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, REGISTERS) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((left == right).mean(axis=1) >= least))

    return keep


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose texts are similar enough. Texts meet by equi-joins; a frequent ``b`` is split by adaptive execution."""
    left = pairs.join(texts.withColumnRenamed("doc_id", "a"), "a").withColumnRenamed("text", "ta")
    both = left.join(texts.withColumnsRenamed({"doc_id": "b", "text": "tb"}), "b")
    hashed = both.select("a", "b", word_hashes(F.lower("ta")).alias("ha"), word_hashes(F.lower("tb")).alias("hb"))
    found = hashed.mapInArrow(_similar, "a bigint, b bigint, similarity double")
    return found.where(F.col("similarity") >= similarity - 1e-9)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, copies, links``, one row per row of ``docs``; ``class_id`` is the smallest id of the class.

    Documents are linked if the probability Jaccard of their five-word shingles (lower case, weighted by count) reaches
    ``similarity``; classes are what links connect. Equal word sequences (``copies`` of them) are one text from the start and are never
    paired. Texts that share a band are candidates:

    1. every text of a bucket is paired with ``CENTERS`` texts of the bucket, the lowest by as many hashes; pairs whose signatures
       do not rule it out are verified;
    2. in buckets whose texts are still of different classes, every text outside the bucket's largest class is compared with all others of
       the bucket, in blocks, over an index of their shingles: only links are written, no pair is.

    So no link between two classes is lost, and within a class none is needed.

    ``links`` counts only the links of the text that were verified on the way to the classes. It is a lower bound of the text's near
    duplicates and depends on the buckets: links within a class mostly show at its centers alone. Texts under five words are one shingle; null, empty and blank texts are
    classes of their own. Rows with equal ids count as one document; a null id is given its text's class, or null.
    """
    scratch = Scratch(docs.sparkSession)
    stage = scratch.stage
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    hashed = rows.select("doc_id", word_hashes(F.lower("text")).alias("hashes")).select(
        "doc_id", F.xxhash64("hashes").alias("k1"), F.xxhash64(F.lit(1), "hashes").alias("k2"), "hashes"
    )
    kinds = "doc_id bigint, k1 bigint, k2 bigint, bands array<bigint>, signature binary"
    signed = stage(hashed.where(F.size("hashes") > 0).mapInArrow(_sign, kinds), "signatures", even=False)
    classes = stage(
        signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "texts"
    )
    first = signed.join(classes.where("copies > 1"), ["k1", "k2"], "left").where("doc_id = coalesce(node, doc_id)")
    banded = first.select(F.explode("bands").alias("key"), "doc_id").distinct()
    lowest = [F.min_by("doc_id", F.xxhash64("doc_id", F.lit(k))) for k in range(CENTERS)]
    buckets = banded.groupBy("key").agg(F.array_distinct(F.array(*lowest)).alias("centers"), F.count("*").alias("n")).where("n > 1")
    members = stage(banded.join(buckets, "key"), "buckets")
    pairs = members.select(F.col("doc_id").alias("a"), F.explode("centers").alias("b")).where("a <> b")
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    signs = first.select("doc_id", "signature")
    for side in ("a", "b"):
        pairs = pairs.join(signs.withColumnsRenamed({"doc_id": side, "signature": f"s{side}"}), side)
    likely = stage(pairs.mapInArrow(_likely(similarity - ESTIMATE_SLACK), "a bigint, b bigint"), "likely")
    # the texts that may be looked at, fetched once
    needed = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(members.where("n > 2").select("doc_id"))
    needed = stage(needed.distinct(), "needed")
    texts = stage(rows.join(needed, "doc_id"), "candidates")
    links = stage(_verified(likely, texts, similarity), "stars")
    roots = stage(components(links), "roots")
    placed = members.where("n > 2").select("key", "doc_id").join(roots, F.col("doc_id") == F.col("node"), "left")
    placed = placed.select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    mixed = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("n"), F.count("*").alias("classes")
    )
    apart = stage(placed.join(mixed.where("classes > 1"), "key"), "apart")
    if not apart.isEmpty():
        # 32 bits of each word's hash are enough inside a bucket and halve what is moved
        narrow = F.transform(word_hashes(F.lower("text")), lambda h: F.shiftright(h, 32).cast("int"))
        with_text = apart.join(texts.groupBy("doc_id").agg(F.min("text").alias("text")).select("doc_id", narrow.alias("hashes")), "doc_id")
        width = apart.select(F.col("n"), "key").distinct()
        words = with_text.groupBy("key").agg(F.sum(F.size("hashes")).alias("words"))
        n_blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")
        counted = width.join(words, "key").select("key", n_blocks.alias("blocks"))
        block = with_text.join(counted, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        dealt = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "key", "doc_id", "root", "hashes", "block", (F.col("root") != F.col("largest")).alias("ask"),
            F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        )
        found = dealt.groupBy("key", "low", "high").applyInPandas(_apart(similarity), "a bigint, b bigint, similarity double")
        links = stage(links.unionByName(found).dropDuplicates(["a", "b"]), "links")
        roots = components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    known = classes.join(roots.withColumnRenamed("root", "_root"), "node", "left").join(ends, "node", "left").select(
        "k1", "k2", F.coalesce("_root", "node").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links")
    )
    out = signed.select("doc_id", "k1", "k2").join(known, ["k1", "k2"]).select("doc_id", "class_id", "copies", "links")
    blank = hashed.where(F.size("hashes") == 0).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("copies"), F.lit(0).cast("bigint").alias("links")
    )
    return out.unionByName(blank)
