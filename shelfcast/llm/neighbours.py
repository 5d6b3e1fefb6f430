"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stop.

Unit vectors are projected on a few Gaussian directions.  A squared distance in the
projection, divided by the squared distance itself, is chi-square distributed, so a search
that meets points in the order of their projected distance may stop once every point left
would need an improbably small ratio to be among the best found.

A kd-tree over the projections of a bounded sample cuts the space into cells; every vector
belongs to one.  Cells are cut into blocks of bounded size, and each block has a kd-tree of
its own.  A query first searches a block of its own cell for a bound, then the blocks of all
cells that the stopping test doesn't exclude.  Equal vectors are searched as one, with the
smallest of their ids, so copies cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import materialise

DIRECTIONS = 8
# The sample that the cells are fitted on, rows of a block (and of a cell, as far as the
# sample tells), points of a leaf, queries that meet a block at once.
SAMPLE = 20_000
BLOCK = 8_192
LEAF = 32
QUERIES = 2_048
# Points verified by one numpy call, as many leaves as they fill.
TOGETHER = 512
# Chance with which a point is let go that would have been among the best.
CONFIDENCE = 0.98
SEED = 5


def chi_square_cdf(x: float, m: int = DIRECTIONS) -> float:
    """For an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def chi_square_quantile(p: float, m: int = DIRECTIONS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < p else (low, mid)
    return high


def _directions(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, DIRECTIONS))


def _vectors(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)


def _projected(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return (vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]) @ directions


def kd_leaves(points: np.ndarray, leaf: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Leaves of a kd-tree cut at medians of the widest side: rows, and the corners of their box."""
    out, work = [], [np.arange(len(points))]
    while work:
        rows = work.pop()
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        side = int((high - low).argmax())
        if len(rows) <= leaf or low[side] == high[side]:
            out.append((rows, low, high))
            continue
        order = rows[np.argsort(points[rows, side], kind="stable")]
        work += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def cells_of(points: np.ndarray, size: int) -> list[tuple]:
    """A kd-tree that covers the whole space: (side, cut, left, right) by node, or (None, cell)."""
    nodes: list = []
    count = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal count
        at = len(nodes)
        nodes.append(None)
        if len(rows) > size:
            spread = points[rows].max(axis=0) - points[rows].min(axis=0)
            side = int(spread.argmax())
            cut = float(np.median(points[rows, side]))
            below = points[rows, side] < cut
            if spread[side] > 0 and below.any() and not below.all():
                nodes[at] = (side, cut, grow(rows[below]), grow(rows[~below]))
                return at
        nodes[at] = (None, count)
        count += 1
        return at

    grow(np.arange(len(points)))
    return nodes


def cell_numbers(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.int64)
    work = [(0, np.arange(len(points)))]
    while work:
        at, rows = work.pop()
        node = nodes[at]
        if node[0] is None:
            out[rows] = node[1]
        else:
            below = points[rows, node[0]] < node[1]
            work += [(node[2], rows[below]), (node[3], rows[~below])]
    return out


def cell_distances(nodes: list[tuple], point: np.ndarray) -> list[tuple[int, float]]:
    """Each cell with the least squared distance that a point in it can have."""
    out, work = [], [(0, 0.0, np.zeros(len(point)))]
    while work:
        at, total, gaps = work.pop()
        node = nodes[at]
        if node[0] is None:
            out.append((node[1], total))
            continue
        gap = point[node[0]] - node[1]
        near, far = (node[2], node[3]) if gap < 0 else (node[3], node[2])
        work.append((near, total, gaps))
        # Crossing a second cut on the same side replaces the first gap, it doesn't add to it.
        beyond = max(gap * gap, gaps[node[0]])
        moved = gaps.copy()
        moved[node[0]] = beyond
        work.append((far, total - gaps[node[0]] + beyond, moved))
    return out


def search(queries: pd.DataFrame, rows: pd.DataFrame, k: int, directions: np.ndarray, stop: float) -> pd.DataFrame:
    """For each query the vectors of a block that are among its best, until they hold ``k`` ids.

    Leaves are met in the order of their projected distance and verified whole, ``TOGETHER``
    points at a time; the search ends when the next one passes the chi-square test against
    the ``k``-th best, or against the bound that came with the query.
    """
    vectors = _vectors(list(rows["raw"]))
    norms = np.sqrt((vectors**2).sum(axis=1))
    points = _projected(vectors, directions)
    leaves = kd_leaves(points, LEAF)
    low, high = np.stack([x[1] for x in leaves]), np.stack([x[2] for x in leaves])
    sizes = np.array([len(x[0]) for x in leaves])
    held = np.array([len(x) for x in rows["ids"]])
    asked = _vectors(list(queries["raw"]))
    places = _projected(asked, directions)
    out = []
    for i in range(len(asked)):
        gap = np.maximum(np.maximum(low - places[i], places[i] - high), 0)
        nearest = (gap**2).sum(axis=1)
        turn = np.argsort(nearest, kind="stable")
        met = np.cumsum(sizes[turn])
        q, norm = asked[i], math.sqrt((asked[i] ** 2).sum())
        best, scores, last = np.zeros(0, dtype=np.int64), np.zeros(0), -2.0
        bound = queries["bound"].iloc[i]
        at = 0
        while at < len(turn) and nearest[turn[at]] <= stop * bound:
            to = max(at + 1, int(np.searchsorted(met, met[at] + TOGETHER)))
            found = np.concatenate([leaves[leaf][0] for leaf in turn[at:to]])
            at = to
            score = (vectors[found] * q).sum(axis=1) / (norms[found] * norm)
            better = score >= last
            if not better.any():
                continue
            best, scores = np.concatenate([best, found[better]]), np.concatenate([scores, score[better]])
            order = np.argsort(-scores, kind="stable")
            full = int(np.searchsorted(np.cumsum(held[best[order]]), k)) + 1
            if full <= len(order):
                # Equal scores stay: their ids decide.
                last = scores[order[full - 1]]
                order = order[scores[order] >= last]
                bound = min(bound, max(0.0, 2 - 2 * last) + 1e-12)
            best, scores = best[order], scores[order]
        out.append(pd.DataFrame({"raw": [queries["raw"].iloc[i]] * len(best), "score": scores, "ids": list(rows["ids"].iloc[best]), "bound": bound}))
    return pd.concat(out) if out else pd.DataFrame({"raw": [], "score": [], "ids": [], "bound": []})


def nearest(
    vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", queries=None, k: int = 5, confidence: float = CONFIDENCE
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col`` and ``score``: the ``k`` nearest found of each query.

    ``queries`` is a condition on ``id_col`` that picks the rows to search for (default: all).
    Nearness is the cosine of the original vectors in double precision, the larger the
    nearer, ties to the smaller id; a row isn't its own neighbour, but other rows with its
    id or vector are.  Null ids, vectors that are null, zero, or hold null or non-finite
    components, and vectors of another length than most of the sample take no part, as
    queries or as neighbours.  Repeated query rows each get their answers; with fewer rows
    than ``k`` all are given; an empty table gives an empty table.  Other columns are not read,
    whatever their names.
    """
    spark = vectors.sparkSession
    asks = F.lit(True) if queries is None else F.coalesce(queries(F.col(id_col)), F.lit(False))
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), asks.alias("asked"))
    plain = plain.where(F.col("id").isNotNull() & F.col("vector").isNotNull())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Equal vectors of a batch leave as one row with the k + 1 smallest of their ids.
        for batch in batches:
            groups: dict[bytes, tuple[list, list]] = {}
            for key, v, a in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if any(x is None for x in v):
                    continue
                x = np.array(v, dtype="<f8") + 0.0
                most = float(np.abs(x).max(initial=0.0))
                if most > 0 and math.isfinite(most):
                    # Scaled by a power of two, which changes no cosine, so that no square over- or underflows.
                    x = np.ldexp(x, -math.frexp(most)[1]) + 0.0
                    g = groups.setdefault(x.tobytes(), ([], []))
                    g[0].append(key)
                    if a:
                        g[1].append(key)
            yield pa.record_batch(
                [
                    pa.array(list(groups), pa.binary()),
                    pa.array([sorted(g[0])[: k + 1] for g in groups.values()], pa.list_(pa.int64())),
                    pa.array([g[1] for g in groups.values()], pa.list_(pa.int64())),
                ],
                names=["raw", "ids", "asked"],
            )

    rows = materialise(plain.mapInArrow(packed, "raw binary, ids array<long>, asked array<long>"), "vectors")
    # Written first, so that the tasks' samples meet in a shuffle and ``SAMPLE`` rows reach the driver.
    sample = materialise(rows.select("raw").orderBy(F.xxhash64("raw"), "raw").limit(SAMPLE), "sample").toPandas()["raw"].tolist()
    sample.sort()
    lengths = pd.Series([len(r) for r in sample], dtype="int64").value_counts()
    size = max((n, b) for b, n in lengths.items())[1] if len(lengths) else 8
    sample = [r for r in sample if len(r) == size]
    directions = _directions(size // 8)
    stop = chi_square_quantile(confidence)
    total = rows.count()
    points = _projected(_vectors(sample), directions) if sample else np.zeros((1, DIRECTIONS))
    nodes = cells_of(points, max(16, math.ceil(len(points) * BLOCK / max(total, 1))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            cells = cell_numbers(nodes, _projected(_vectors(raw), directions)) if raw else np.zeros(0, np.int64)
            yield pa.record_batch([*batch.columns, pa.array(cells)], names=["raw", "ids", "asks", "cell"])

    # Each batch of each task sent k + 1 ids of a vector at most.
    classes = (
        rows.where(F.length("raw") == size)
        .groupBy("raw")
        .agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.max(F.size("asked") > 0).alias("asks"))
        .mapInArrow(placed, "raw binary, ids array<long>, asks boolean, cell long")
    )
    classes = materialise(classes, "classes")
    # A row per cell, and there are fewer cells than rows in the sample.
    per_cell = classes.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).alias("parts"))
    per_cell = F.broadcast(materialise(per_cell, "cells"))
    blocks = classes.join(per_cell, "cell").select("raw", "ids", "cell", F.pmod(F.xxhash64("raw"), F.col("parts")).alias("part"))
    searched = classes.where("asks").select("raw", "cell")
    found_kind = "raw binary, score double, ids array<long>, bound double"

    def meet(pairs: DataFrame) -> DataFrame:
        """Search the blocks (cell, part) for the queries that name them, ``QUERIES`` at a time."""
        load = pairs.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("_turns"))
        turn = blocks.join(load, ["cell", "part"]).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_turns") - 1)).alias("turn"))
        here = pairs.join(load, ["cell", "part"]).withColumn("turn", F.pmod(F.xxhash64("raw", F.lit(3)), F.col("_turns")))
        keys = ["cell", "part", "turn"]

        def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(r):
                return pd.DataFrame({"raw": [], "score": [], "ids": [], "bound": []})
            return search(q, r, k + 1, directions, stop)

        # New names for the columns both sides stem from.
        here, turn = here.toDF(*here.columns), turn.toDF(*turn.columns)
        return here.groupBy(*keys).cogroup(turn.groupBy(*keys)).applyInPandas(run, found_kind)

    home = searched.select("raw", "cell", F.lit(0).cast("long").alias("part"), F.lit(float("inf")).alias("bound"))
    bounds = meet(home).groupBy("raw").agg(F.min("bound").alias("bound"))
    bounds = materialise(searched.join(bounds, "raw", "left").select("raw", F.coalesce("bound", F.lit(float("inf"))).alias("bound")), "bounds")

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bound = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            if raw:
                for r, b, p in zip(raw, bound, _projected(_vectors(raw), directions), strict=True):
                    out += [(r, b, c) for c, d in cell_distances(nodes, p) if d <= stop * b]
            yield pa.record_batch(
                [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.int64())],
                names=["raw", "bound", "cell"],
            )

    pairs = bounds.mapInArrow(routed, "raw binary, bound double, cell long").join(per_cell, "cell")
    pairs = pairs.select("raw", "bound", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    found = materialise(meet(materialise(pairs, "pairs")), "found")
    # k + 1 ids of each block at most, then the best k + 1 of all blocks.
    best = found.select("raw", "score", F.explode("ids").alias("id")).groupBy("raw").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k + 1).alias("best")
    )
    askers = rows.select("raw", F.explode("asked").alias("query_id"))
    answers = askers.join(best, "raw").select("query_id", "best")
    # The query's own row is the one among equal vectors that bears its id; take one such out.
    own = F.array_position(F.transform("best", lambda b: b["id"]), F.col("query_id"))
    rest = F.filter("best", lambda b, i: i + 1 != own)
    ranked = answers.select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("at", "b"))
    return ranked.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias(id_col), (-F.col("b.s")).alias("score")
    )
