"""Connected components of a table of links by stars of tasks and jumps of pointers.

First each task replaces its links by stars: everything that its links join points to the smallest id.
A round is one shuffle and one join. Dealt by the id that points, stars of several tasks meet and are
joined in the same way; then whoever points to an id that points on itself points there. As a task's
stars name an id once, a hub with very many neighbours is never gathered by the shuffle, and the join's
partitions can be split by AQE. Nothing is collected but whether anything was still open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Links that a task joins at once.
ROWS_AT_ONCE = 1_000_000


class Forest:
    """Union-find over positions; roots are kept as an array so that whole tiles are looked up."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (deeper := self.root[self.root]) is not None and (deeper != self.root).any():
                self.root = deeper


def _stretches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[np.ndarray]:
    """Links in arrays of some ``rows``; equal ``a`` that follow each other are not parted."""
    held, n = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]))
        n += batch.num_rows
        if n >= rows:
            links = np.concatenate(held, 1)
            before = np.flatnonzero(links[0] != links[0, -1])
            if len(before):
                yield links[:, : before[-1] + 1]
                links = links[:, before[-1] + 1 :]
            held, n = [links], links.shape[1]
    if n:
        yield np.concatenate(held, 1)


def _stars(links: DataFrame) -> DataFrame:
    """a, b, open: what the links of a task join points to its smallest id.

    ``open``: ``a`` was no ``a`` of these links, so it may point elsewhere too.
    """
    rows = ROWS_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _stretches(batches, rows):
            names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            forest, own = Forest(len(names)), np.zeros(len(names), bool)
            forest.join(at[: len(a)], at[len(a) :])
            own[at[: len(a)]] = True
            points = np.flatnonzero(forest.root != np.arange(len(names)))
            columns = [pa.array(x) for x in (names[points], names[forest.root[points]], ~own[points])]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "open"])

    return links.select("a", "b").mapInArrow(shared.tidy(run), "a long, b long, open boolean")


def stars(links: DataFrame) -> DataFrame:
    """a, component: for every id of a link that is not the smallest of its component, the smallest.

    ``links`` has two long columns ``a`` and ``b``; direction, repeats and loops do not matter. Ids
    without a row are components' smallest ones, or in no link. The rows are materialised, and can be
    links again, together with others.
    """
    state = shared.materialise(_stars(links))
    while True:
        met = _stars(state.repartition("a").sortWithinPartitions("a"))
        # Of what is not open each ``a`` has one row.
        on = met.where("not open").select(F.col("a").alias("b"), F.col("b").alias("next"))
        state = shared.materialise(met.join(on, "b", "left").select("a", F.coalesce("next", "b").alias("b"), (F.col("open") | F.col("next").isNotNull()).alias("open")))
        if state.where("open").isEmpty():
            return state.select("a", F.col("b").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """a, component: for every id of a link the smallest id that can be reached.

    ``links`` as in ``stars``; an id that is linked to itself only has no row.
    """
    found = stars(links)
    return found.unionByName(found.select(F.col("component").alias("a"), "component").distinct())
