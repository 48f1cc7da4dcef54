"""Packed masks against sets of cells."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import joins, masks, project


def drawn(rng, keys, width, height):
    return {(k, rng.randrange(width), rng.randrange(height)) for k in keys for _ in range(rng.choice([0, 1, 40]))} | {(0, width - 1, height - 1), (0, 0, 0)}


@pytest.mark.parametrize(("width", "height"), [(7, 3), (63, 4), (64, 5), (65, 2), (200, 6)])
def test_words_equal_cells(spark, width, height):
    rng = random.Random(width)
    a, b = drawn(rng, range(6), width + 3, height + 2), drawn(rng, range(6), width + 3, height + 2)
    frame = lambda cells: spark.createDataFrame([*cells, *list(cells)[:3]], "key int, x int, y int")
    keys = spark.range(8).select(F.col("id").cast("int").alias("key"))
    assert {tuple(r) for r in masks.unpack(masks.pack(frame(a), "key"), "key").collect()} == a
    inside = lambda cells: {c for c in cells if c[1] < width and c[2] < height}
    assert {tuple(r) for r in masks.unpack(masks.clip(masks.pack(frame(a), "key"), width, height), "key").collect()} == inside(a)
    wide = inside({(k, x + dx, y + dy) for k, x, y in a for dx in (-1, 0, 1) for dy in (-1, 0, 1) if x + dx >= 0 and y + dy >= 0})
    assert {tuple(r) for r in project.dilate(frame(a).withColumnRenamed("key", "mask"), width, height).collect()} == wide
    of = lambda cells, k: {c for c in cells if c[0] == k}
    iou = {r.key: r.iou for r in joins.mask_iou(frame(a), frame(b), width, height, keys).collect()}
    for k in range(8):
        x, y = of(inside(a), k), of(inside(b), k)
        assert iou[k] == (round(len(x & y) / len(x | y), 6) if x | y else 1.0)
    for r in masks.stats(masks.pack(frame(a), "key"), keys).collect():
        own = of(a, r.key)
        xs, ys = [c[1] for c in own], [c[2] for c in own]
        assert tuple(r)[1:] == ((len(own), min(xs), min(ys), max(xs) + 1, max(ys) + 1) if own else (0, None, None, None, None))


def test_no_masks(spark):
    none = spark.createDataFrame([], "key int, x int, y int")
    keys = spark.createDataFrame([(1,)], "key int")
    assert masks.dilate(masks.pack(none, "key"), 5, 5).count() == 0
    assert [tuple(r) for r in masks.overlap(masks.pack(none, "key"), masks.pack(none, "key"), keys).collect()] == [(1, 0, 0)]
