"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts of one set are one node with a SimHash fingerprint of 256 bits. Fingerprints are compared in
tiles with exclusive-or and bit counts, as in ``simhash``; as a radius that covers similarity 0.8 leaves
no differences of population counts to skip, a tile is a class of sizes, and who is up to a class of
similarity smaller visits it. All pairs whose sizes allow the similarity meet in just one tile. Pairs
within the radius make SimHash groups, and within a group sets of shingles are compared exactly, so that
components are those of the similarity and not those of the fingerprints.

Links are found in three rounds. In the first, each node of a group names the closest of the nodes
beside it, so a group of many near copies costs one exact comparison a member, and not one a pair. The
second takes the groups that are left with several components, and in them the nodes that are within the
radius of another component. Their sets travel to the group once each, whatever the number of pairs;
there a node meets the others from the closest on, and only as long as they are in other components, so
most pairs never need a comparison. A group of more shingles than a task should hold is dealt to blocks;
the third round compares what stands in different blocks, pair by pair. No pair of a group within the
radius is passed over, but those that are already joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, shared, simhash

WIDTH, SIMILARITY = 5, 0.8
WORDS = ["f0", "f1", "f2", "f3"]
#: Bits that may differ in the first 64, the first 128 and all 256 of a fingerprint. Sets of similarity 0.8
#: differ in 15 % of the bits, those of four and five shingles in 19 %: 4.3 or more standard deviations below.
FIRST, RADIUS, WHOLE = 25, 44, 76
#: Classes of sizes from a size to the smallest that can be similar to it.
STEPS = 4
#: Nodes of a tile that one block compares, and rows of a group of tiles.
HOMES_PER_TILE, ROWS_PER_GROUP = 65_536, 25_000
#: Neighbours, in the order of fingerprints, that a node is compared with in the first round.
BESIDE = 64
#: Shingles of the tiles that a task of the second round holds.
BLOCK_SHINGLES = 4_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of one text (A-Z lower-cased).

    A text of fewer words than ``width`` is one shingle, a text without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(sizes + 1) - sizes - 1
    last = min(width, len(words)) - 1
    ends = (start + sizes)[last:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], simhash.SEED) for s, e in zip(start.tolist(), ends)], np.uint64))


def node_of(hashes: np.ndarray) -> int:
    """Signed 64-bit name of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), simhash.SEED)).view(np.int64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """256-bit SimHash of a set, as four unsigned numbers."""
    counts = np.zeros(256, np.int64)
    for at in range(0, len(hashes), 4096):
        words = [hashes[at : at + 4096]]
        for _ in range(3):
            words.append(_mixed(_mixed(words[-1])))
        each = np.ascontiguousarray(np.stack(words, 1))
        counts += np.unpackbits(each.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def _can_link(similarity: float) -> int:
    """The fewest shingles of a set that can be so similar to another set."""
    return int(np.ceil(similarity / max(1 - similarity, 1e-9) - 1e-6))


def prints(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, node, n (shingles), f0 to f3 (fingerprint) of every document.

    Sets too small to be similar to any other set have an empty fingerprint.
    """
    least = _can_link(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, marks = [], [], []
            for text in (t for _, texts in shared.texts_of(batch, 1) for t in texts):
                h = shingles(text, width)
                nodes.append(node_of(h))
                sizes.append(len(h))
                marks.append(fingerprint(h).view(np.int64) if len(h) >= least else np.zeros(4, np.int64))
            f = np.array(marks, np.int64).reshape(-1, 4)
            columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), *(pa.array(f[:, i]) for i in range(4))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", *WORDS])

    return shared.id_text(docs).mapInArrow(shared.tidy(run), "doc_id long, node long, n int, f0 long, f1 long, f2 long, f3 long")


def _stars(tile, home, node, n, words: list[np.ndarray], radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius between the homes of each tile and the rows before them by size, as stars of nodes."""
    order = np.lexsort((node, n, tile))
    tile, home, node, n = tile[order], home[order], node[order], n[order]
    f0, f1, f2, f3 = (w[order] for w in words)
    forest = components.Forest(len(tile))
    high, wide = 64, 1024
    differ, apart = np.empty(high * wide, np.uint64), np.empty(high * wide, np.uint8)
    for s, e in _runs(tile):
        homes, sizes = np.flatnonzero(home[s:e]) + s, n[s:e]
        for rows in (homes[i : i + high] for i in range(0, len(homes), high)):
            first = int(np.searchsorted(sizes, similarity * n[rows[0]] - 1e-9)) + s
            for j in range(first, int(rows[-1]), wide):
                to = f0[j : min(j + wide, rows[-1])]
                x, c = (m[: len(rows) * len(to)].reshape(len(rows), len(to)) for m in (differ, apart))
                np.bitwise_xor(f0[rows, None], to[None], out=x)
                np.bitwise_count(x, out=c)
                near = np.flatnonzero(c.ravel() <= FIRST)
                a, b = rows[near // len(to)], near % len(to) + j
                bits = c.ravel()[near].astype(np.int16) + np.bitwise_count(f1[a] ^ f1[b])
                ok = np.flatnonzero(bits <= radius)
                a, b = a[ok], b[ok]
                bits = bits[ok] + np.bitwise_count(f2[a] ^ f2[b]) + np.bitwise_count(f3[a] ^ f3[b])
                ok = (bits <= WHOLE) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9)
                if ok.any():
                    forest.join(a[ok], b[ok])
    linked = np.flatnonzero(forest.root != np.arange(len(tile)))
    return node[linked], node[forest.root[linked]]


def simhash_groups(nodes: DataFrame, count: int, radius: int, similarity: float) -> DataFrame:
    """node, key: the SimHash group (by one of its nodes) of each node that has others within the radius.

    ``nodes``: node, n, f0 to f3. A tile of many nodes is cut into blocks; whoever visits it, its homes
    included, visits each of them.
    """
    per_block = min(HOMES_PER_TILE, max(4096, count // 16))
    size = F.floor(F.log("n") * (STEPS / max(-np.log(similarity), 1e-9))).cast("long")
    sized = nodes.select("node", "n", *WORDS, size.alias("size"))
    large = shared.materialise(sized.groupBy(F.col("size").alias("tile")).count().where(F.col("count") > per_block).select("tile", F.ceil(F.col("count") / per_block).cast("int").alias("blocks")))
    # One class more, as the logarithms are rounded.
    visits = sized.withColumn("tile", F.explode(F.sequence(F.col("size"), F.col("size") + STEPS + 1))).join(shared.bounded(large), "tile", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = (F.col("tile") == F.col("size")) & (F.pmod(F.xxhash64("node"), F.col("blocks")) == F.col("block"))
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("home", own).drop("blocks", "size")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = np.unique(np.stack([pdf["tile"].to_numpy(np.int64), pdf["block"].to_numpy(np.int64)], 1), axis=0, return_inverse=True)[1].ravel()
        words = [pdf[w].to_numpy(np.int64).view(np.uint64) for w in WORDS]
        return _pairs(*_stars(tile, pdf["home"].to_numpy(bool), pdf["node"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), words, radius, similarity))

    links = visits.groupBy(_groups(["tile", "block"], max(4, -(-count * (STEPS + 2) // ROWS_PER_GROUP)))).applyInPandas(compare, "a long, b long")
    return components.components(links).select(F.col("a").alias("node"), F.col("component").alias("key"))


def _near(f0: tuple, f1: tuple, n: tuple, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances, and whether they are within the radius and the sizes allow the similarity."""
    apart = np.bitwise_count(f0[0] ^ f0[1]).astype(np.int16) + np.bitwise_count(f1[0] ^ f1[1])
    return apart, (apart <= radius) & (np.minimum(*n) >= similarity * np.maximum(*n) - 1e-9)


def beside(key, node, n, f0, f1, radius: int, similarity: float, width: int = BESIDE) -> tuple[np.ndarray, np.ndarray]:
    """First round: for each row the closest of its neighbours within the radius in its group."""
    order = np.lexsort((node, f1, f0, key))
    key, node, n, f0, f1 = key[order], node[order], n[order], f0[order], f1[order]
    best = np.full(len(key), 999, np.int16)
    other = np.full(len(key), -1)
    for lag in range(1, min(width + 1, len(key))):
        at = np.flatnonzero(key[lag:] == key[:-lag])
        if not len(at):
            break
        apart, ok = _near((f0[at], f0[at + lag]), (f1[at], f1[at + lag]), (n[at], n[at + lag]), radius, similarity)
        better = ok & (apart < best[at + lag])
        best[at[better] + lag] = apart[better]
        other[at[better] + lag] = at[better]
    found = np.flatnonzero(other >= 0)
    return node[found], node[other[found]]


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """From and to of the runs of rows with equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    edge = np.flatnonzero(new)
    yield from zip(edge.tolist(), [*edge[1:].tolist(), len(new)])


def crossing(n, f0, f1, component, radius: int, similarity: float) -> np.ndarray:
    """Which nodes of one block lie within the radius of a node of another component."""
    out = np.zeros(len(n), bool)
    for i in range(0, len(n), 256):
        rows = slice(i, i + 256)
        for j in range(i, len(n), 8192):
            to = slice(j, j + 8192)
            ok = _near((f0[rows, None], f0[None, to]), (f1[rows, None], f1[None, to]), (n[rows, None], n[None, to]), radius, similarity)[1]
            ok &= component[rows, None] != component[None, to]
            out[rows] |= ok.any(1)
            out[to] |= ok.any(0)
    return out


def joined(n, f0, f1, component, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links (of rows of one block) that join components; what stays apart has been compared throughout."""
    own, links = np.unique(component, return_inverse=True)[1], []
    for i in range(len(n) - 1):
        apart, ok = _near((f0[i], f0[i + 1 :]), (f1[i], f1[i + 1 :]), (n[i], n[i + 1 :]), radius, similarity)
        near = np.flatnonzero(ok)
        near = near[np.argsort(apart[near], kind="stable")] + i + 1
        step = 8
        while len(near := near[own[near] != own[i]]):
            part, near = near[:step], near[step:]
            flat = np.concatenate([sets[k] for k in part])
            place = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
            common = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.cumsum(n[part]) - n[part])
            for k in part[common >= similarity * (n[i] + n[part] - common) - 1e-9]:
                if own[k] != own[i]:
                    links.append((i, int(k)))
                    own[own == own[k]] = own[i]
            step *= 2
    return links


def across(key, node, n, f0, f1, component, block, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Third round: all pairs of a tile within the radius in different components and different blocks."""
    order = np.lexsort((node, component, key))
    key, node, n, f0, f1, component, block = (x[order] for x in (key, node, n, f0, f1, component, block))
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, e in _runs(key):
        if component[s] == component[e - 1]:
            continue
        for i in range(s, e, 256):
            rows = slice(i, min(i + 256, e))
            # Rows are in the order of their components: later rows of the first one's need not be met.
            first = int(np.searchsorted(component[s:e], component[i], "right")) + s
            for j in range(min(first, rows.stop), e, 8192):
                to = slice(j, min(j + 8192, e))
                ok = _near((f0[rows, None], f0[None, to]), (f1[rows, None], f1[None, to]), (n[rows, None], n[None, to]), radius, similarity)[1]
                a, b = np.nonzero(ok & (component[rows, None] < component[None, to]) & (block[rows, None] != block[None, to]))
                out_a.append(node[a + i])
                out_b.append(node[b + j])
    return np.concatenate(out_a), np.concatenate(out_b)


_TILE = "key long, block int, node long, n int, f0 long, f1 long, component long"


def _arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """Columns of tiles as arrays, fingerprints unsigned."""
    out = {c: pdf[c].to_numpy(np.int64) for c in ("key", "node", "n", "component", "block") if c in pdf}
    return out | {c: pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("f0", "f1")}


def _groups(keys: list[str], groups: int):
    return F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("grp")


def _pairs(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    shared.give_back()
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _first(nodes: DataFrame, count: int, radius: int, similarity: float) -> DataFrame:
    """a, b (a < b): the closest pairs of the first round."""
    width = BESIDE

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _arrays(pdf)
        return _pairs(*beside(x["key"], x["node"], x["n"], x["f0"], x["f1"], radius, similarity, width))

    return nodes.groupBy(_groups(["key"], max(4, -(-count // simhash.ROWS_PER_GROUP)))).applyInPandas(compare, "a long, b long")


def _open_tiles(nodes: DataFrame, component: DataFrame) -> DataFrame:
    """The tiles that hold several components, dealt to blocks; ``blocks``: how many their tile has."""
    tiles = nodes.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = tiles.groupBy("key").agg(F.sum("n").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    several = several.select("key", F.ceil(F.col("size") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return tiles.join(several, "key").withColumn("block", block)


def _sets(nodes: DataFrame, docs: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """node, has: the sets of shingles of some nodes."""
    one = found.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                each = [shingles(t, width) for t in batch.column(1).slice(part, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(h) for h in each], pa.int64()), pa.array([h.tobytes() for h in each], pa.binary())], ["node", "has"])

    texts = shared.id_text(docs).join(one.select("doc_id").distinct(), "doc_id", "left_semi")
    # An id may have several texts: of those only the wanted ones, and one of each, are kept.
    return shared.stored(texts.mapInArrow(shared.tidy(sets), "node long, has binary").join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _second(tiles: DataFrame, docs: DataFrame, found: DataFrame, width: int, radius: int, similarity: float) -> DataFrame:
    """a, b: links that join components within blocks of tiles, compared exactly."""
    rows = tiles.agg(F.count("*")).first()[0]

    def involved(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "block"], kind="stable")
        x, keep = _arrays(pdf), np.zeros(len(pdf), bool)
        for s, e in _runs(x["key"], x["block"]):
            keep[s:e] = crossing(*(x[c][s:e] for c in ("n", "f0", "f1", "component")), radius, similarity)
        shared.give_back()
        return pdf[keep][["key", "block", "node", "n", "f0", "f1", "component"]]

    left = tiles.groupBy(_groups(["key", "block"], max(4, -(-rows // simhash.ROWS_PER_GROUP)))).applyInPandas(involved, _TILE)
    left = shared.stored(left, "crossing")
    size = left.agg(F.sum("n")).first()[0] or 0
    has = _sets(left.select("node").distinct(), docs, found, width)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "block", "node"], kind="stable")
        x, sets, a, b = _arrays(pdf), [np.frombuffer(h, np.uint64) for h in pdf["has"]], [], []
        for s, e in _runs(x["key"], x["block"]):
            for i, k in joined(*(x[c][s:e] for c in ("n", "f0", "f1", "component")), sets[s:e], radius, similarity):
                a.append(x["node"][s + i])
                b.append(x["node"][s + k])
        return _pairs(np.array(a, np.int64), np.array(b, np.int64))

    met = left.join(has, "node").groupBy(_groups(["key", "block"], max(4, -(-size // BLOCK_SHINGLES) * 4)))
    return met.applyInPandas(meet, "a long, b long")


def _third(tiles: DataFrame, radius: int, similarity: float) -> DataFrame:
    """a, b: pairs in different blocks of one tile, and still in different components."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _arrays(pdf)
        return _pairs(*across(*(x[c] for c in ("key", "node", "n", "f0", "f1", "component", "block")), radius, similarity))

    return tiles.groupBy("key").applyInPandas(compare, "a long, b long")


def _similar(pairs: DataFrame, docs: DataFrame, found: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose sets have the similarity, compared exactly."""
    has = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, found, width)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[place] == y).sum())
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(has.select(F.col("node").alias("a"), F.col("has").alias("has_a")), "a").join(has.select(F.col("node").alias("b"), F.col("has").alias("has_b")), "b")
    return both.select("a", "b", "has_a", "has_b").mapInArrow(shared.tidy(common), "a long, b long")


def near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, component_id for every document: the smallest doc_id that can be reached over links.

    Null and empty texts and texts of white space are one node. Repeated rows come out repeatedly;
    an empty table gives an empty result; further columns and rows without an id are ignored. A very
    long text is one set of shingles, of about three times its size.
    """
    found = shared.stored(prints(docs, width, similarity), "prints")
    marked = shared.stored(found.where(F.col("n") >= _can_link(similarity)).select("node", "n", *WORDS).dropDuplicates(["node"]), "marked")
    groups = simhash_groups(marked, marked.count(), radius, similarity)
    nodes = shared.stored(marked.select("node", "n", "f0", "f1").join(groups, "node"), "nodes")
    first = shared.materialise(_first(nodes, nodes.count(), radius, similarity))
    # Stars stand for the links that they come from.
    grown = lambda links: components.stars(links).withColumnRenamed("a", "node")
    more = lambda component, links: grown(component.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
    component = grown(_similar(first, docs, found, width, similarity))
    tiles = shared.stored(_open_tiles(nodes, component), "open-tiles")
    if not tiles.isEmpty():
        component = more(component, _second(tiles, docs, found, width, radius, similarity))
        split = tiles.where("blocks > 1").drop("component").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        across = shared.materialise(_third(split, radius, similarity))
        if not across.isEmpty():
            component = more(component, _similar(across, docs, found, width, similarity))
    placed = shared.materialise(found.select("doc_id", "node").join(component, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component")))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "component").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest doc_id.

    All columns are kept. Of repeated rows with that doc_id all stay, as they are one document; rows
    without an id go.
    """
    keep = near_copies(docs, width, similarity, radius).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi")
