"""Vectors as blocks of integers, and sums over groups of them that stay exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Vectors of a block: what a task holds at once.
BLOCK = 4096


def finite(vector: Column) -> Column:
    """Whether a vector is there and none of its components is null or not finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def floors(x: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers. Beyond ``limit`` distances would not be exact: an error."""
    down = np.floor(scale * np.asarray(x, np.float64))
    if down.size and np.abs(down).max() > limit:
        raise ValueError(f"a component times {scale} is larger than {limit}: its distances would not fit 64 bits")
    return down.astype(np.int64)


def matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """A list column of which every row has ``width`` values, as rows of a matrix."""
    lists = batch.column(batch.schema.get_field_index(column))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def slices(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows of a task, at most ``block`` at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, block):
            yield batch.slice(at, block)


#: A task's sums: for each group (part, entry) the number of its members and their sum by component.
SUMS = "part int, entry int, n long, sums array<long>"


def summed(blocks: DataFrame, members: Callable[[dict], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Members and componentwise sums of each (part, entry), whatever the number of blocks.

    ``members`` gives for a block (a row of ``blocks`` as a dict) each part with the counts and the
    sums of its entries. A task adds its blocks up and sends one row a group; those are added as
    decimals, so that no sum overflows. What comes to the driver is one number for each part, entry and
    component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                for part, n, sums in members(batch.slice(i, 1).to_pylist()[0]):
                    a, b = total.get(part, (0, 0))
                    total[part] = (a + n, b + sums)
        rows = [{"part": p, "entry": k, "n": int(n[k]), "sums": sums[k].tolist()} for p, (n, sums) in total.items() for k in np.flatnonzero(n).tolist()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    spread = blocks.mapInArrow(shared.tidy(run), SUMS).select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sorted(spread.groupBy("part", "entry", "at").agg(exact("n"), exact("x")).collect(), key=lambda r: r["at"]):
        out.setdefault((r["part"], r["entry"]), (int(r["n"]), []))[1].append(int(r["x"]))
    return out
