"""Approximate nearest neighbours by largest inner product: stable projections in a kd-tree.

Inner products become distances by one further coordinate, sqrt(M^2 - |x|^2) with M the largest
norm, and 0 for a query. A few Gaussian (2-stable) projections keep distances in distribution: the
squared projected distance over the squared true one is chi-square with as many degrees of freedom
as there are projections. Each block of candidates has a kd-tree over its projections; a query
visits the leaves in the order of their distance, verifies their vectors exactly, and stops when an
unseen vector as near as the k-th found would with probability ``sure`` have shown up before.

Candidates are dealt to cells of a kd-tree over the same projections, fitted on a bounded sample;
every vector belongs to a cell. A query first searches its own cell, which gives a distance that the
k-th nearest cannot exceed; then it goes only to the cells for which the stopping test does not hold
at that distance. In tasks of bounded size cells meet the queries that come to them, and a query's
finds are merged by a ranking that keeps ``k`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Candidates and queries of a task, points of a leaf, queries worked on at once.
BLOCK, QUERY_BLOCK, LEAF, AT_ONCE = 16_384, 32_768, 64, 256
PROJECTIONS, SEED = 8, 20_24
#: Rows of the sample that the cells are fitted on, and sample rows of a cell.
SAMPLE, SAMPLE_LEAF = 50_000, 32


def chi_square(x: np.ndarray, degrees: int = PROJECTIONS) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.minimum(x / 2, 700)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def planes(width: int) -> np.ndarray:
    """Directions of the projections of vectors of a length; the last row is that of the further coordinate."""
    return np.random.default_rng(SEED).standard_normal((width + 1, PROJECTIONS))


def stops(away: np.ndarray, square: np.ndarray, kth: np.ndarray, sure: float) -> np.ndarray:
    """Whether nothing at a squared projected distance of ``away`` or more need be seen.

    ``square``: squared norm of the query and of the largest vector together; ``kth``: the score of
    the k-th nearest found so far (-inf: fewer were found).
    """
    distance = np.where(np.isfinite(kth), np.maximum(square - 2 * np.where(np.isfinite(kth), kth, 0), 0), np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(distance > 0, away / distance, np.where(away > 0, np.inf, 0.0))
    return chi_square(ratio) >= sure


def kd_cells(points: np.ndarray, leaf: int) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, cut, below, above) of a kd-tree over a sample; a negative child is cell -1 - child."""
    nodes: list[list] = []
    cells = 0

    def grow(own: np.ndarray) -> int:
        nonlocal cells
        wide = own.max(0) - own.min(0) if len(own) else np.zeros(1)
        if len(own) <= leaf or not wide.max() > 0:
            cells += 1
            return -cells
        axis = int(np.argmax(wide))
        cut = float(np.median(own[:, axis]))
        low = own[:, axis] < cut
        if not low.any():
            low = own[:, axis] <= cut
        at = len(nodes)
        nodes.append([axis, cut, 0, 0])
        nodes[at][1] = float(own[~low, axis].min()) if (~low).any() else cut
        nodes[at][2], nodes[at][3] = grow(own[low]), grow(own[~low])
        return at

    grow(points)
    return [tuple(n) for n in nodes]


def cell_of(nodes: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    """The cell of each point: below a node's cut or not."""
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))] if nodes else []
    while todo:
        node, rows = todo.pop()
        if node < 0:
            out[rows] = -1 - node
        elif len(rows):
            axis, cut, below, above = nodes[node]
            low = points[rows, axis] < cut
            todo += [(below, rows[low]), (above, rows[~low])]
    return out


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points in the leaves of a kd-tree, and the leaves' edges in that order."""
    order, edges, todo = np.arange(len(points)), [0], [(0, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            edges.append(b)
            continue
        own = points[order[a:b]]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, axis], middle, kind="introselect")]
        todo += [(a + middle, b), (a, a + middle)]
    return order, np.array(edges)


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, top_norm: float, sure: float, reached: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the k nearest that each query finds in one block.

    ``reached``: score of the k-th nearest that each query has found elsewhere.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(ids) or not len(query_ids):
        return none
    order = np.lexsort((ids,))
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
    # Copies are one point with its smallest ids: no task grows with the number of copies.
    rows = (vectors + 0.0).view([("", vectors.dtype)] * vectors.shape[1]).ravel()
    _, first, copy = np.unique(rows, return_index=True, return_inverse=True)
    points = vectors[first]
    by_copy = np.argsort(copy, kind="stable")
    edge = np.searchsorted(copy[by_copy], np.arange(len(points) + 1))
    extra = np.sqrt(np.maximum(top_norm**2 - (points**2).sum(1), 0))
    plane = planes(vectors.shape[1])
    flat = points @ plane[:-1] + extra[:, None] * plane[-1]
    leaf_order, edges = kd_leaves(flat)
    points, flat = points[leaf_order], flat[leaf_order]
    low = np.minimum.reduceat(flat, edges[:-1])
    high = np.maximum.reduceat(flat, edges[:-1])
    leaves, need, out = len(edges) - 1, min(k + 1, len(points)), []
    step = max(2, leaves // 12)
    for at in range(0, len(queries), AT_ONCE):
        q = queries[at : at + AT_ONCE]
        shadow = q @ plane[:-1]
        gap = np.maximum(np.maximum(low[None] - shadow[:, None], shadow[:, None] - high[None]), 0)
        away = (gap**2).sum(2)
        visit = np.argsort(away, axis=1, kind="stable")
        away = np.take_along_axis(away, visit, 1)
        product = np.full((len(q), len(points)), -np.inf)
        square = (q**2).sum(1) + top_norm**2
        active, done = np.arange(len(q)), 0
        floor = np.full(len(q), -np.inf) if reached is None else reached[at : at + AT_ONCE]
        # What the cells' test has let through may still be too far away as a whole.
        if reached is not None:
            active = active[~stops(away[:, 0], square, floor, sure)]
        while len(active) and done < leaves:
            to = min(done + step, leaves)
            who, which = np.repeat(active, to - done), visit[active, done:to].ravel()
            by_leaf = np.argsort(which, kind="stable")
            who, which = who[by_leaf], which[by_leaf]
            cut = np.searchsorted(which, np.arange(leaves + 1))
            for leaf in range(leaves):
                asked = who[cut[leaf] : cut[leaf + 1]]
                if len(asked):
                    a, b = edges[leaf], edges[leaf + 1]
                    product[asked, a:b] = q[asked] @ points[a:b].T
            done = to
            if done < leaves:
                kth = np.partition(product[active], len(points) - need, axis=1)[:, len(points) - need]
                active = active[~stops(away[active, done], square[active], np.maximum(kth, floor[active]), sure)]
        kth = np.partition(product, len(points) - need, axis=1)[:, len(points) - need]
        for i in range(len(q)):
            near = np.flatnonzero(product[i] >= kth[i] - 1e-9 * (1 + abs(kth[i]))) if np.isfinite(kth[i]) else np.flatnonzero(np.isfinite(product[i]))
            if not len(near):  # the whole block is too far away
                continue
            # The same sum for the same vector wherever it stands, so that ties are ties.
            score = (points[near] * q[i]).sum(1)
            found_ids, found_scores = [], []
            for p, s in zip(near, score):
                c = leaf_order[p]
                own = ids[by_copy[edge[c] : min(edge[c + 1], edge[c] + k + 1)]]
                found_ids.append(own)
                found_scores.append(np.full(len(own), s))
            i_ids, i_scores = np.concatenate(found_ids), np.concatenate(found_scores)
            other = i_ids != query_ids[at + i]
            i_ids, i_scores = i_ids[other], i_scores[other]
            best = np.lexsort((i_ids, -i_scores))[:k]
            out.append((np.full(len(best), query_ids[at + i]), i_ids[best], i_scores[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else none


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part, one for each id.

    Left out: null ids, null or empty vectors, zero vectors, and vectors with null or non-finite
    components. Of different vectors of one id the smallest (component by component) counts; repeated
    rows are one. Further columns are ignored, whatever their names.
    """
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", v.cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    return shared.materialise(rows.where(~odd & F.exists(v, lambda x: x != 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))


def search(candidates: DataFrame, queries: DataFrame, k: int = 20, sure: float = 0.97, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query up to ``k`` nearest candidates but itself.

    Both tables have vec_id and embedding, as from ``usable``. Ties go to the smaller vec_id; the
    score is the inner product in double precision. Vectors of different lengths have none: a query
    meets the candidates of its own length. An empty side gives an empty result. Cells are fitted on
    at most ``sample`` candidates, every candidate is in one; a task holds about ``block`` candidates.
    """
    size = F.size("embedding")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    # As a rule one length; their number is bounded by the largest.
    lengths = candidates.groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.max(norm).alias("m")).join(queries.select(size.alias("size")).distinct(), "size").collect()
    found = None
    for own in sorted(lengths):
        top_norm = math.sqrt(own.m) * (1 + 1e-12)
        part = _search_length(candidates.where(size == own["size"]), queries.where(size == own["size"]), own["size"], own.n, top_norm, k, sure, sample, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = candidates.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score"))
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_length(candidates: DataFrame, queries: DataFrame, width: int, n: int, top_norm: float, k: int, sure: float, sample: int, block: int) -> DataFrame:
    """query_id, vec_id, score of up to ``k`` finds in each task, for vectors of one length."""
    plane = planes(width)

    def projected(vectors: pd.Series, query: bool) -> np.ndarray:
        x = np.stack(vectors) if len(vectors) else np.zeros((0, width))
        flat = x @ plane[:-1]
        return flat if query else flat + np.sqrt(np.maximum(top_norm**2 - (x**2).sum(1), 0))[:, None] * plane[-1]

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"f": list(projected(b["embedding"], False))})

    # Cells of about a block each, as far as the sample can tell them apart.
    share = max(SAMPLE_LEAF, -(-min(n, sample) * block // max(n, 1)))
    picked = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).mapInPandas(flatten, "f array<double>").toPandas()
    nodes = kd_cells(np.stack(picked["f"]) if len(picked) else np.zeros((0, PROJECTIONS)), share)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flat = projected(b["embedding"], False)
            yield b.assign(cell=cell_of(nodes, flat), f=list(flat))

    placed = shared.stored(candidates.mapInPandas(assign, "vec_id long, embedding array<double>, cell long, f array<double>"), "cells")
    # One row a cell, of which there are at most sample / SAMPLE_LEAF.
    edge = lambda fn: F.array(*(fn(F.col("f")[i]) for i in range(PROJECTIONS)))
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), edge(F.min).alias("low"), edge(F.max).alias("high")).orderBy("cell").toPandas()
    cells, low, high = boxes["cell"].to_numpy(np.int64), np.stack(boxes["low"]), np.stack(boxes["high"])
    blocks = np.maximum(1, -(-boxes["n"].to_numpy(np.int64) // block))
    deep = F.create_map(*(x for c, b in zip(cells.tolist(), blocks.tolist()) if b > 1 for x in (F.lit(c), F.lit(b)))) if (blocks > 1).any() else None
    cut = F.lit(0) if deep is None else F.pmod(F.xxhash64("vec_id"), F.coalesce(F.try_element_at(deep, F.col("cell")), F.lit(1))).cast("int")
    dealt = placed.select("vec_id", "embedding", "cell", cut.alias("block"))
    number = {int(c): i for i, c in enumerate(cells)}

    def away(flat: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(low[None] - flat[:, None], flat[:, None] - high[None]), 0)
        return (gap**2).sum(2)

    def visits(first: bool):
        """Each query with the cells and blocks that it goes to."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), AT_ONCE):
                    b = whole.iloc[at : at + AT_ONCE]
                    far = away(projected(b["embedding"], True))
                    nearest = far.argmin(1)
                    if first:
                        wanted = np.zeros(far.shape, bool)
                        wanted[np.arange(len(b)), nearest] = True
                    else:
                        square = np.array([(v**2).sum() for v in b["embedding"]]) + top_norm**2
                        kth = b["kth"].fillna(-np.inf).to_numpy(float)
                        wanted = ~stops(far, square[:, None], kth[:, None], sure)
                        wanted[np.arange(len(b)), nearest] = False
                    who, which = np.nonzero(wanted)
                    times = blocks[which]
                    inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    who, which = np.repeat(who, times), np.repeat(which, times)
                    yield pd.DataFrame({"vec_id": b["vec_id"].to_numpy()[who], "embedding": b["embedding"].to_numpy()[who], "kth": (b["kth"].to_numpy(float) if "kth" in b else np.full(len(b), np.nan))[who], "cell": cells[which], "block": inside.astype(np.int32)})

        return run

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        reached = right["kth"].fillna(-np.inf).to_numpy(float)
        q, i, s = search_block(left["vec_id"].to_numpy(), np.stack(left["embedding"]), right["vec_id"].to_numpy(), np.stack(right["embedding"]), k, top_norm, sure, reached)
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    def met(asked: DataFrame, first: bool) -> DataFrame:
        """Finds of a round. Where very many queries come to a cell they are split, and meet copies of it."""
        to = asked.mapInPandas(visits(first), "vec_id long, embedding array<double>, kth double, cell long, block int")
        split = F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")
        a = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).groupBy("cell", "block", "part")
        b = to.withColumn("part", split).groupBy("cell", "block", "part")
        return a.cogroup(b).applyInPandas(compare, "query_id long, vec_id long, score double")

    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    # Fresh columns, as both sides may come from one table.
    asked = queries.select(F.col("vec_id").alias("vec_id"), F.col("embedding").alias("embedding"))
    first = shared.materialise(_ranked(met(asked, True), k))
    if len(number) == 1:
        return first.drop("rank")
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    again = asked.join(kth, "vec_id", "left")
    return first.drop("rank").unionByName(met(again, False))


def op5_stable_projection_search(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20, among all vectors."""
    rows = usable(shared.table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where("vec_id % 20 = 0"))
