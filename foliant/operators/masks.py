"""Masks as rows of 64-bit words: intersection, union, counts and dilation of 64 cells at a time.

Packed: key, y, word, bits; bit i of ``word`` w is the cell x = 64 * w + i of line y. Lines and words
without a cell have no row. Cells are those with x and y of 0 or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64


def _one(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def _left(bits: Column, n: int) -> Column:
    return F.shiftleft(bits, n)


def _right(bits: Column, n: int) -> Column:
    return F.shiftrightunsigned(bits, n)


def pack(cells: DataFrame, key: str) -> DataFrame:
    """``cells`` (key, x, y; repeats allowed) as words."""
    inside = cells.where((F.col("x") >= 0) & (F.col("y") >= 0))
    word = F.floor(F.col("x") / BITS).cast("int")
    return inside.groupBy(F.col(key).alias("key"), F.col("y").cast("int").alias("y"), word.alias("word")).agg(F.bit_or(_one(F.col("x") % BITS)).alias("bits"))


def unpack(words: DataFrame, key: str) -> DataFrame:
    """The cells of words: key, x, y."""
    some = words.select(F.col("key").alias(key), "y", "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("i"))
    return some.where(F.col("bits").bitwiseAND(_one(F.col("i"))) != 0).select(key, (F.col("word") * BITS + F.col("i")).cast("int").alias("x"), "y")


def clip(words: DataFrame, width: int, height: int) -> DataFrame:
    """The words within ``width`` and ``height``; cells beyond go."""
    last, rest = divmod(width, BITS)
    edge = F.lit((1 << rest) - 1 if rest < BITS - 1 else (1 << 63) - 1).cast("long")
    bits = F.when(F.col("word") < last, F.col("bits")).otherwise(F.col("bits").bitwiseAND(edge))
    within = words.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("word") >= 0) & (F.col("word") <= last)).withColumn("bits", bits)
    return within.where("bits <> 0")


def overlap(a: DataFrame, b: DataFrame, keys: DataFrame) -> DataFrame:
    """key, both, either: cells of the intersection and of the union of two sides, 0 where both are empty."""
    left = a.select("key", "y", "word", F.col("bits").alias("_a"))
    right = b.select("key", "y", "word", F.col("bits").alias("_b"))
    x, y = (F.coalesce(c, F.lit(0).cast("long")) for c in ("_a", "_b"))
    met = left.join(right, ["key", "y", "word"], "full_outer")
    counts = met.groupBy("key").agg(F.sum(F.bit_count(x.bitwiseAND(y))).alias("both"), F.sum(F.bit_count(x.bitwiseOR(y))).alias("either"))
    return keys.select("key").join(counts, "key", "left").select("key", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("both", "either")))


def stats(words: DataFrame, keys: DataFrame) -> DataFrame:
    """key, n, x0, y0, x1, y1: number of cells and bounding box (null if empty, end exclusive)."""
    bits = F.col("bits")
    # The cells below the lowest one are the ones that subtracting 1 sets; all bits up to the highest are set by smearing it.
    lowest = F.bit_count(F.bitwise_not(bits).bitwiseAND(F.when(bits == F.lit(-(1 << 63)), F.lit((1 << 63) - 1)).otherwise(bits - 1)))
    high = bits
    for n in (1, 2, 4, 8, 16, 32):
        high = F.transform(F.array(high), lambda h: h.bitwiseOR(_right(h, n)))[0]  # noqa: B023  used at once
    at = F.col("word") * BITS
    some = words.where("bits <> 0")
    box = some.groupBy("key").agg(
        F.sum(F.bit_count(bits)).cast("long").alias("n"), F.min(at + lowest).cast("int").alias("x0"), F.min("y").alias("y0"),
        F.max(at + F.bit_count(high)).cast("int").alias("x1"), (F.max("y") + 1).alias("y1"),
    )
    return keys.select("key").join(box, "key", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def dilate(words: DataFrame, width: int, height: int) -> DataFrame:
    """Each cell with its eight neighbours, clipped to the bounds: three rows a word, and what it carries over."""
    bits = F.col("bits")
    place = lambda word, own: F.struct(word.cast("int").alias("word"), own.alias("bits"))
    own = place(F.col("word"), bits.bitwiseOR(_left(bits, 1)).bitwiseOR(_right(bits, 1)))
    up = F.when(bits < 0, place(F.col("word") + 1, F.lit(1).cast("long")))
    down = F.when(bits.bitwiseAND(F.lit(1).cast("long")) != 0, place(F.col("word") - 1, F.lit(-(1 << 63)).cast("long")))
    wide = words.select("key", "y", F.explode(F.array_compact(F.array(own, up, down))).alias("w")).select("key", "y", "w.word", "w.bits")
    tall = wide.select("key", F.explode(F.array(*(F.col("y") + d for d in (-1, 0, 1)))).alias("y"), "word", "bits")
    return clip(tall.groupBy("key", "y", "word").agg(F.bit_or("bits").alias("bits")), width, height)
