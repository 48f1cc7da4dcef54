"""SimHash fingerprints and exact near-duplicate links between them.

Fingerprints are compared in tiles with exclusive-or and bit counts. A tile holds the distinct
fingerprints whose parts (four of 16 bits, or eight of 8 bits for a large corpus) have the same
population counts. Two fingerprints within radius r cannot lie in tiles whose counts differ by more
than r in sum, so only those tile pairs meet. Each fingerprint visits the tiles above its own in that
range (21 of four parts at radius 2, 73 of eight), so the rows that are shuffled grow with the number
of distinct fingerprints, whatever the number of copies. A tile of more than HOMES_PER_TILE
fingerprints is cut into blocks, and only those who visit such a tile visit each of its blocks. A
tile returns a spanning star for each local group, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, shared

SEED = 42
ROWS_PER_GROUP = 150_000
HOMES_PER_TILE = 250_000
#: Distinct fingerprints from which on eight parts part them better than four.
MANY = 30_000_000


def fingerprint(text: str, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of one text (A-Z lower-cased), as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(sizes + 1) - sizes - 1
        ends = (start + sizes)[width - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(start.tolist(), ends)]
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, "<u8")
    for at in range(0, len(values), 8192):
        part = values[at : at + 8192]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = counts * 2 > len(values)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long. Texts without words have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, width) for _, texts in shared.texts_of(batch, 1) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return shared.id_text(docs).mapInArrow(shared.tidy(run), "doc_id long, fp long")


def _offsets(radius: int, parts: int) -> list[tuple[int, ...]]:
    """Differences of the counts within the radius, one of each pair of opposites."""
    found = [()]
    for _ in range(parts):
        found = [(*d, x) for d in found for x in range(-radius, radius + 1) if sum(map(abs, d)) + abs(x) <= radius]
    return [d for d in found if d >= (0,) * parts]


def _stars(tile: np.ndarray, fp: np.ndarray, home: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius between homes and all rows of each tile, as stars of nodes."""
    order = np.lexsort((~home, tile))
    tile, fp, home, node = tile[order], fp[order], home[order], node[order]
    edge = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]) if len(tile) else np.zeros(0, np.int64)
    forest = components.Forest(len(tile))
    for s, e in zip(edge, np.r_[edge[1:], len(tile)]):
        homes = int(home[s:e].sum())
        if not homes or e - s < 2:
            continue
        for i in range(s, s + homes, 256):
            rows = fp[i : min(i + 256, s + homes), None]
            for j in range(i, e, 8192):
                near = np.bitwise_count(rows ^ fp[None, j : min(j + 8192, e)]) <= radius
                a, b = np.nonzero(near)
                keep = a + i < b + j
                if keep.any():
                    forest.join(a[keep] + i, b[keep] + j)
    linked = np.flatnonzero(forest.root != np.arange(len(tile)))
    return node[linked], node[forest.root[linked]]


def link_components(prints: DataFrame, radius: int = 2, parts: int | None = None, homes_per_tile: int = HOMES_PER_TILE) -> DataFrame:
    """fp, node, component: for each distinct fingerprint its smallest doc_id and its component.

    ``prints``: doc_id, fp (as from ``fingerprints``). Two fingerprints link at ``radius`` or fewer
    differing bits; the component is the smallest doc_id that can be reached over links.
    """
    distinct = shared.materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    total = distinct.count()
    parts = parts or (4 if total < MANY else 8)
    width = 64 // parts
    offsets = _offsets(radius, parts)
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1))) for i in range(parts)]

    def tile(shift: str = "0") -> str:
        """Number of the tile with the given differences from the fingerprint's own counts."""
        digits = [f"(q{i} + {shift.format(i=i)})" for i in range(parts)]
        return " + ".join(f"{d} * {(width + 1) ** (parts - 1 - i)}L" for i, d in enumerate(digits))

    counted = distinct.select("fp", "node", *(q.alias(f"q{i}") for i, q in enumerate(counts)))
    # Tiles too large for one task: at most one for each homes_per_tile fingerprints.
    large = shared.materialise(counted.groupBy(F.expr(tile()).alias("tile")).count().where(F.col("count") > homes_per_tile).select("tile", F.ceil(F.col("count") / homes_per_tile).cast("int").alias("blocks")))
    visits = (
        counted.withColumn("d", F.explode(F.array(*(F.struct(*(F.lit(x).alias(f"d{i}") for i, x in enumerate(d))) for d in offsets))))
        .where(" and ".join(f"q{i} + d.d{i} between 0 and {width}" for i in range(parts)))
        .select("fp", "node", F.expr(tile("d.d{i}")).alias("tile"), F.expr(" and ".join(f"d.d{i} = 0" for i in range(parts))).alias("home"))
        .join(shared.bounded(large), "tile", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    )
    # Whoever visits a tile that is cut into blocks, its homes included, visits each of them.
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("home", F.col("home") & (F.col("block") == own)).drop("blocks")
    groups = max(1, -(-total * len(offsets) // ROWS_PER_GROUP))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        key = np.unique(np.stack([pdf["tile"].to_numpy(np.int64), pdf["block"].to_numpy(np.int64)], 1), axis=0, return_inverse=True)[1].ravel()
        a, b = _stars(key, pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["home"].to_numpy(bool), pdf["node"].to_numpy(np.int64), radius)
        return pd.DataFrame({"a": a, "b": b})

    links = visits.groupBy(F.pmod(F.xxhash64("tile", "block"), F.lit(groups)).alias("grp")).applyInPandas(compare, "a long, b long")
    found = components.stars(links)
    return distinct.join(found.withColumnRenamed("a", "node"), "node", "left").select("fp", "node", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id for every document.

    Null and empty texts and texts of white space have fingerprint zero and link like any other.
    Texts of fewer words than ``width`` are one shingle; of a very long text all shingles' hashes are
    held at once, about thirty times its size. Repeated rows come out repeatedly; an empty
    table gives an empty result; further columns and rows without an id are ignored.
    """
    prints = shared.materialise(fingerprints(docs, width))
    groups = link_components(prints, radius)
    return prints.join(groups.select("fp", F.col("component").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """The documents without near duplicates: of each component the one with the smallest doc_id.

    All columns are kept. Of repeated rows with that doc_id all stay, as they are one document; rows
    without an id go.
    """
    keep = near_duplicates(docs, width, radius).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi")


def op6_simhash_tiles(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = near_duplicates(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
