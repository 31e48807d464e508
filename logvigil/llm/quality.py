"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators for a linear SVM fitted by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.llm.encoding import byte_batches, release, texts_of

BUCKETS = 1 << 17
SAMPLE_ROWS = 12_000  # labelled rows to fit on; the only bound, whatever the size of the corpus
FOLDS, HELD_OUT_FOLD = 5, 0
THRESHOLD = 0.3
_MIX = np.random.default_rng(20240101).integers(1 << 62, size=(6, 64), dtype=np.uint64) | np.uint64(1)
_UPPER, _LOWER, _DIGIT, _MARK = 1, 2, 4, 8
_KIND = np.full(256, _LOWER, np.uint8)  # bytes of letters beyond ASCII count as lower case
_KIND[:128] = _MARK
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("a") : ord("z") + 1] = _LOWER
_KIND[ord("0") : ord("9") + 1] = _DIGIT


def ngrams(text: str) -> np.ndarray:
    """Distinct n-gram buckets of a text: 1 and 2 words, 3 bytes, and 1 to 2 word shapes.

    A shape says which kinds of characters a word has, how it ends and whether it repeats the word before.
    """
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return np.empty(0, np.int64)
    found, wide = [], data.astype(np.uint64)
    if len(data) > 2:
        found.append(wide[:-2] * _MIX[0, 0] + wide[1:-1] * _MIX[0, 1] + wide[2:] * _MIX[0, 2])
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if len(begin):
        place = np.arange(len(data)) - np.repeat(np.r_[0, end], np.diff(np.r_[0, end, len(data)]))
        gap = begin - np.r_[0, end[:-1]]
        place = place - np.repeat(np.r_[gap, 0], np.diff(np.r_[0, end, len(data)]))
        solid = ~blank
        values = np.where(solid, (wide + np.uint64(1)) * _MIX[1, place & 63], np.uint64(0))
        word = np.add.reduceat(values, begin) if len(begin) else values[:0]
        # a segment of reduceat runs to the next word's begin; blanks in between count nothing
        kinds = np.bitwise_or.reduceat(np.where(solid, _KIND[data], 0), begin).astype(np.uint64)
        same = np.r_[False, word[1:] == word[:-1]].astype(np.uint64)
        shape = kinds * np.uint64(512) + _tail(data, begin, end).astype(np.uint64) * np.uint64(2) + same
        for row, stream in ((2, word), (4, shape)):
            found.append(stream * _MIX[row, 0])
            found.append(stream[:-1] * _MIX[row, 1] + stream[1:] * _MIX[row, 2] + np.uint64(row))
    mixed = np.concatenate(found) if found else np.empty(0, np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[5, 0]
    hit = np.zeros(BUCKETS, bool)
    hit[(mixed >> np.uint64(47)).astype(np.int64)] = True
    return np.flatnonzero(hit)


def packed(buckets: np.ndarray) -> bytes:
    """Ascending buckets as gaps of a byte each, a quarter of what whole numbers take; a byte of 255 only adds to the next gap."""
    full, last = np.divmod(np.diff(buckets, prepend=0), 255)
    out = np.full(len(last) + int(full.sum()), 255, np.uint8)
    out[np.cumsum(full + 1) - 1] = last
    return out.tobytes()


def unpacked(gaps: bytes) -> np.ndarray:
    """The buckets that :func:`packed` wrote."""
    step = np.frombuffer(gaps, np.uint8)
    return np.cumsum(step, dtype=np.int32)[step != 255]


def _tail(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The last byte of a word if it is a mark, else its kind."""
    last = data[end - 1]
    return np.where(_KIND[last] == _MARK, last, _KIND[last])


@dataclass(frozen=True)
class Model:
    """Weight per bucket (ratio times coefficient), the ratios, bias, and the line of the logistic score."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, buckets: np.ndarray) -> float:
        norm = float(np.sqrt(np.square(self.ratios[buckets], dtype=np.float64).sum()))
        return self.bias + (float(self.weights[buckets].sum(dtype=np.float64)) / norm if norm else 0.0)

    def score(self, buckets: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(buckets) + self.shift, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], label: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of how much commoner each bucket is in class 1 than in class 0."""
    counts = np.full((2, BUCKETS), smooth)
    for buckets, y in zip(rows, label, strict=True):
        counts[int(y), buckets] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def fit_margin(rows: list[np.ndarray], label: np.ndarray, cost: float = 1.0, epochs: int = 8, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Ratios, coefficients and bias of the hinge-loss model, by dual coordinate descent over unit-length rows."""
    ratios = log_count_ratios(rows, label)
    norm = np.array([np.sqrt(v @ v) or 1.0 for v in (ratios[b] for b in rows)])
    sign = np.where(label > 0, 1.0, -1.0)
    share = np.clip(np.array([(sign < 0).mean(), (sign > 0).mean()]), 1e-9, None)
    limit = cost * np.where(sign > 0, 0.5 / share[1], 0.5 / share[0])  # both classes weigh the same
    coef, bias, alpha, random = np.zeros(BUCKETS), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    square = np.array([v @ v for v in (ratios[b] / n for b, n in zip(rows, norm, strict=True))]) + 1.0
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            v = ratios[b := rows[k]] / norm[k]  # made anew: the values of all rows would take three times the memory of the rows
            gradient = sign[k] * (coef[b] @ v + bias) - 1
            new = min(max(alpha[k] - gradient / square[k], 0.0), limit[k])
            if new != alpha[k]:
                step = (new - alpha[k]) * sign[k]
                coef[b] += step * v
                bias += step
                alpha[k] = new
    return ratios, coef, bias


def fit_scale(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits labels to margins, by Newton steps (smoothed targets)."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        w = p * (1 - p)
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.array([[(w * margin**2).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(slope), 0.0), float(shift)


def fit(rows: list[np.ndarray], label: np.ndarray) -> Model:
    """The model; its scale is fitted on margins of rows left out of their fit. One class alone gives its share as score."""
    n1 = float(label.sum())
    if n1 in (0.0, float(len(label))):
        share = (n1 + 1) / (len(label) + 2)
        zero = np.zeros(BUCKETS, np.float32)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    part = np.random.default_rng(11).permutation(len(rows)) % 2
    margin = np.zeros(len(rows))
    for side in (0, 1):
        train = np.flatnonzero(part != side)
        test = np.flatnonzero(part == side)
        if len({*label[train].tolist()}) == 2:
            r, c, b = fit_margin([rows[k] for k in train], label[train])
            half = Model(r * c, r, b, 1, 0)
            margin[test] = [half.margin(rows[k]) for k in test]
    ratios, coef, bias = fit_margin(rows, label)
    return Model((ratios * coef).astype(np.float32), ratios.astype(np.float32), bias, *fit_scale(margin, label))


def remainder(id_col: str, folds: int = FOLDS) -> F.Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def training_sample(labels: DataFrame, label_col: str, sample_rows: int, id_col: str = "doc_id") -> DataFrame:
    """``id, label`` of at most ``sample_rows`` labelled documents outside the held-out fold, the same at every run.

    Null ids and labels are left out; a document labelled twice counts as 1 only if all its labels are.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (remainder(id_col) != HELD_OUT_FOLD))
    one = usable.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("_label"))
    return one.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the bounded sample, in one task; only the fitted vectors come to the driver.

    The sample's ids are broadcast, as ``sample_rows`` bounds them; of its texts the n-gram buckets are shuffled, a byte each. Tables
    without usable labels give a model that scores 0.5.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_batches(batch, "text"):
                rows = pa.array([packed(ngrams(t)) for t in texts_of(part, "text")], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_label"), rows], ["_id", "_label", "buckets"])
                release()

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_id", kind="stable")
        model = fit([unpacked(b) for b in rows["buckets"]], rows["_label"].to_numpy(np.int64))
        head = [model.bias, model.slope, model.shift]
        return pd.DataFrame({"weights": [model.weights.tobytes()], "ratios": [model.ratios.tobytes()], "head": [head]})

    sample = training_sample(labels, label_col, sample_rows, id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id")
    rows = texts.mapInArrow(features, f"_id {kind}, _label int, buckets binary").withColumn("_all", F.lit(0))
    found = rows.groupBy("_all").applyInPandas(fitted, "weights binary, ratios binary, head array<double>").collect()
    if not found:
        return fit([], np.empty(0, np.int64))
    weights, ratios = (np.frombuffer(bytes(found[0][c]), np.float32) for c in ("weights", "ratios"))
    return Model(weights, ratios, *found[0]["head"])


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and ``held_out``.

    The text alone decides. Null and empty texts get the model's prior; null ids count as held out by the rule of their text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of BUCKETS floats

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for part in texts:
            yield pd.Series([known.score(ngrams(t or "")) for t in part], dtype="float64")
            release()

    held = F.coalesce(remainder(id_col) == HELD_OUT_FOLD, F.lit(False))
    return docs.withColumn("score", scored(F.col(text_col))).withColumns(
        {"predicted": (F.col("score") >= threshold).cast("int"), "held_out": held}
    )
