"""Approximate nearest neighbours by stable projections: a kd-tree over few dimensions and a chi-square stopping test.

Vectors are lengthened to equal norm (one more component), so that the largest inner product is the smallest distance.
A few Gaussian (2-stable) projections keep distances in distribution: the squared projected distance over the
squared distance is chi-square with as many degrees of freedom as projections. Projected neighbours are visited in
order of distance and verified on the original vectors; once the projected distance is so large that a vector nearer than the
worst kept one would lie beyond it only with probability ``1 - sure``, the search ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logvigil.session import stage

PROJECTIONS = 12
SURE = 0.96
LEAF_ROWS = 64
BLOCK_ROWS = 4096  # rows of one task's tree
SAMPLE_ROWS = 16_384  # rows the cells are fitted on
CELLS = 256  # cells at most; larger cells are split among several trees by a hash
QUERY_ROWS = 2048  # queries of one task


def chi_square_cdf(x: float, df: int) -> float:
    """Probability that a chi-square variable stays under ``x`` (series of the incomplete gamma function)."""
    if x <= 0:
        return 0.0
    a, half = df / 2, x / 2
    if half > a + 40 + 8 * a**0.5:
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-14:
        n += 1
        term *= half / n
        total += term
    return min(1.0, total * exp(-half + a * log(half) - lgamma(a)))


def chi_square_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, df + 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, df) < p else (lo, mid)
    return hi


def projections(dim: int, count: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, count))


def lengthen(vectors: np.ndarray, norm: float) -> np.ndarray:
    """The vectors with a last component that gives all of them length ``norm``."""
    rest = np.maximum(norm**2 - np.einsum("ij,ij->i", vectors, vectors), 0)
    return np.column_stack([vectors, np.sqrt(rest)])


def tree_boxes(points: np.ndarray, leaf_rows: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Leaves of a kd-tree (row numbers), with the lowest and highest corner of each: median cuts on the widest axis."""
    leaves, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        part = points[rows]
        width = part.max(axis=0) - part.min(axis=0)
        if len(rows) <= leaf_rows or not width.max() > 0:
            leaves.append(rows)
            continue
        order = np.argsort(part[:, int(width.argmax())], kind="stable")
        half = len(rows) // 2
        open_ += [rows[order[:half]], rows[order[half:]]]
    low = np.array([points[r].min(axis=0) for r in leaves])
    high = np.array([points[r].max(axis=0) for r in leaves])
    return leaves, low, high


def box_distances(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance from every query to every box."""
    out = np.zeros((len(queries), len(low)))
    for axis in range(queries.shape[1]):
        q = queries[:, axis : axis + 1]
        out += np.square(np.maximum(np.maximum(low[:, axis] - q, q - high[:, axis]), 0))
    return out


def search(
    ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, projected: np.ndarray,
    norm: float, k: int, stop: float, bounds: np.ndarray,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every query its number, ids and scores of the best rows found here, best first, ties to smaller ids.

    ``bounds`` is a squared distance per query that the k-th neighbour is known not to exceed. Leaves are visited in order of their
    projected distance, one, two, four ... at a time; the stopping test comes after each such step.
    """
    leaves, low, high = tree_boxes(points, LEAF_ROWS)
    square = np.einsum("ij,ij->i", queries, queries) + norm**2
    for start in range(0, len(queries), 256):
        near = box_distances(projected[start : start + 256], low, high)
        for row, away in enumerate(near):
            n = start + row
            best_ids, best = np.empty(0, ids.dtype), np.empty(0)
            reach = stop * bounds[n]
            order, at, step = np.argsort(away, kind="stable"), 0, 1
            while at < len(order) and away[order[at]] <= reach:
                next_ = order[at : at + step]
                rows = np.concatenate([leaves[leaf] for leaf in next_[away[next_] <= reach]])
                at, step = at + step, step * 2
                gap = points[rows] - projected[n]
                rows = rows[(np.einsum("ij,ij->i", gap, gap) <= reach) & (ids[rows] != query_ids[n])]
                if not len(rows):
                    continue
                best_ids = np.concatenate([best_ids, ids[rows]])
                best = np.concatenate([best, np.einsum("ij,j->i", vectors[rows], queries[n])])
                if len(best) > k:
                    keep = np.lexsort((best_ids, -best))[:k]
                    best_ids, best = best_ids[keep], best[keep]
                if len(best) >= k:
                    worst = max(square[n] - 2 * best.min(), 0.0)
                    reach = min(reach, stop * worst * (1 + 1e-9) + 1e-12)
            order = np.lexsort((best_ids, -best))
            yield n, best_ids[order], best[order]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vec`` (doubles) of vectors that can be searched: not null, not zero, all components finite."""
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0))


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    count: int = PROJECTIONS, sure: float = SURE, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query (id divisible by ``every``).

    Cells are cut by a kd-tree over the projections of a bounded sample (``sample_rows``), but every row is put into its cell;
    cells over ``BLOCK_ROWS`` are split into blocks by a hash, so equal vectors cannot fill a task. A query first searches one
    block of the cell it lies in, which bounds its k-th distance; it then goes to the blocks of those cells only that come within
    the stopping radius. Null ids and vectors that are null, zero or not finite take no part, nor do vectors of another length
    than the commonest. Rows with the same id
    and score count once, a query never finds its own id, and a repeated query id is searched once.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2"))
    top = sizes.orderBy(F.desc("n"), "dim").limit(1).collect()
    if not top:
        return spark.createDataFrame([], empty)
    dim, total, norm = top[0]["dim"], top[0]["n"], float(top[0]["norm2"]) ** 0.5
    matrix = projections(dim, count)
    rows = rows.where(F.size("vec") == dim)
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vec").collect()])
    per_cell = max(LEAF_ROWS, -(-len(sample) // max(1, min(CELLS, -(-total // BLOCK_ROWS)))))
    cuts = _cells(lengthen(sample, norm) @ matrix, per_cell)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            points = lengthen(np.array(part["vec"].tolist()).reshape(-1, dim), norm) @ matrix
            yield pd.DataFrame({"id": part["id"], "vec": part["vec"], "cell": _route(points, cuts).astype("int32"), "point": list(points)})

    placed = stage(rows.mapInPandas(put, "id bigint, vec array<double>, cell int, point array<double>"), "placed")
    corners = [reduce_(F.col("point")[d]).alias(f"{n}{d}") for d in range(count) for n, reduce_ in (("low", F.min), ("high", F.max))]
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), *corners).collect()  # at most CELLS rows
    blocks = {c["cell"]: -(-c["n"] // BLOCK_ROWS) for c in cells}
    known = np.array([c["cell"] for c in cells])
    low = np.array([[c[f"low{d}"] for d in range(count)] for c in cells])
    high = np.array([[c[f"high{d}"] for d in range(count)] for c in cells])
    n_blocks = F.element_at(F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]), F.col("cell"))
    held = placed.withColumn("block", F.pmod(F.xxhash64("id"), n_blocks).cast("int"))
    flat = np.zeros((dim + 1, count))
    flat[:dim] = matrix[:dim]  # queries get 0 as last component
    queries = stage(placed.where(f"id % {every} = 0").dropDuplicates(["id"]).select("id", "vec"), "queries")
    stop = chi_square_quantile(sure, count)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            q = np.array(part["vec"].tolist()).reshape(-1, dim) @ flat[:dim]
            cell = known[box_distances(q, low, high).argmin(axis=1)]
            yield pd.DataFrame({"id": part["id"], "vec": part["vec"], "cell": cell.astype("int32"), "bound": np.inf})

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            q = np.array(part["vec"].tolist()).reshape(-1, dim) @ flat[:dim]
            away = box_distances(q, low, high)
            reach = stop * part["bound"].to_numpy()[:, None]
            for row, keep in zip(part.itertuples(index=False), away <= reach, strict=True):
                hit = known[keep]
                if len(hit):
                    yield pd.DataFrame({"id": row.id, "vec": [row.vec] * len(hit), "cell": hit.astype("int32"), "bound": row.bound})

    def look(key, found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(found) and len(asked):
            q = np.array(asked["vec"].tolist()).reshape(-1, dim)
            v = np.array(found["vec"].tolist()).reshape(-1, dim)
            p = np.array(found["point"].tolist()).reshape(-1, count)
            qid = asked["id"].to_numpy(np.int64)
            for n, ids, scores in search(found["id"].to_numpy(np.int64), v, p, qid, q, q @ flat[:dim], norm, k, stop, asked["bound"].to_numpy()):
                out["query_id"].append(np.repeat(qid[n], len(ids)))
                out["vec_id"].append(ids)
                out["score"].append(scores)
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})

    def ask(queries: DataFrame, one_block: bool) -> DataFrame:
        """Queries at the blocks of their cells; many queries of one block are dealt to several copies of it."""
        there = F.array(F.pmod(F.xxhash64("id"), n_blocks).cast("int")) if one_block else F.sequence(F.lit(0), n_blocks.cast("int") - 1)
        asked = queries.withColumn("block", F.explode(there))
        crowd = asked.groupBy("cell", "block").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("copies"))
        asked = asked.join(F.broadcast(crowd), ["cell", "block"]).withColumn("copy", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int"))
        rows = held.join(F.broadcast(crowd), ["cell", "block"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        keys = ["cell", "block", "copy"]
        pair = rows.groupBy(keys).cogroup(asked.select("id", "vec", "bound", *keys).groupBy(keys))
        return pair.applyInPandas(look, "query_id bigint, vec_id bigint, score double")

    schema = "id bigint, vec array<double>, cell int, bound double"
    first = stage(ask(queries.mapInPandas(home, schema), one_block=True), "first")
    bounds = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    length = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    worst = F.greatest(length + norm**2 - 2 * F.col("worst"), F.lit(0.0)) * (1 + 1e-9) + 1e-12
    bounded = queries.join(bounds, queries["id"] == bounds["query_id"], "left").select(
        "id", "vec", F.when(F.col("n") >= k, worst).otherwise(float("inf")).alias("bound")
    )
    # what the first search found stays in: the second may stop short of it
    found = ask(bounded.mapInPandas(others, schema), one_block=False).unionByName(first).distinct()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cells(points: np.ndarray, rows: int) -> list[tuple[int, float, int, int]]:
    """Cuts of a kd-tree over the sample: axis, value, and the two sides (a cut's number, or -1 - cell)."""
    cuts, cells = [], 0
    open_ = [(points, None, 0)]
    while open_:
        part, parent, side = open_.pop()
        width = part.max(axis=0) - part.min(axis=0)
        axis = int(width.argmax())
        value = float(np.median(part[:, axis]))
        left = part[:, axis] <= value
        if len(part) <= rows or not width.max() > 0 or left.all():
            here, cells = -1 - cells, cells + 1
        else:
            here = len(cuts)
            cuts.append([axis, value, 0, 0])
            open_ += [(part[left], here, 2), (part[~left], here, 3)]
        if parent is not None:
            cuts[parent][side] = here
    return [tuple(c) for c in cuts]


def _route(points: np.ndarray, cuts: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The cell of every point."""
    at = np.zeros(len(points), np.int64) if cuts else np.full(len(points), -1)
    while (inner := at >= 0).any():
        for number in np.unique(at[inner]):
            axis, value, low, high = cuts[number]
            here = np.flatnonzero(at == number)
            at[here] = np.where(points[here, axis] <= value, low, high)
    return -1 - at
