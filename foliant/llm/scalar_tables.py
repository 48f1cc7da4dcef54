"""Clusters around centroids by scalar lookup tables, in integers throughout.

Vectors are kept as blocks in which each dimension is a dictionary of the integers that occur and a
code for each vector. A round tabulates, for each dimension, occurring integer and centroid, the
squared difference; a vector's distances are what its codes find in these tables, added up. New
centroids come from counting the codes of each cluster, which are then weighed with their integers.
Nothing is multiplied for each vector, and no float rounds.

Blocks are made once and need no shuffle; a round moves one row for each task and cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, vectors

BLOCKS = "ids array<long>, sizes array<int>, known binary, codes binary"


def tables_of(x: np.ndarray) -> tuple[list[int], bytes, bytes]:
    """Of the columns of a block: how many integers occur in each, these integers, and a code for each row.

    Codes take one byte where all dictionaries are that small, else two; a block has 4,096 rows at most.
    """
    found = [np.unique(c, return_inverse=True) for c in x.T]
    sizes = [len(v) for v, _ in found]
    kind = "u1" if max(sizes, default=0) <= 256 else "<u2"
    return sizes, b"".join(v.astype("<i8").tobytes() for v, _ in found), b"".join(c.astype(kind).tobytes() for _, c in found)


class Block:
    """The dictionaries and codes of a block."""

    def __init__(self, row: dict) -> None:
        self.ids, sizes = row["ids"], row["sizes"]
        n, width = len(self.ids), len(sizes)
        edges = np.cumsum([0, *sizes])
        known = np.frombuffer(row["known"], "<i8")
        self.known = [known[a:b] for a, b in zip(edges, edges[1:])]
        kind = "u1" if len(row["codes"]) == n * width else "<u2"
        self.codes = np.frombuffer(row["codes"], kind).reshape(width, n)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector (the first of equals) and its squared distance."""
        far = np.zeros((len(self.ids), len(centroids)), np.int64)
        for known, codes, centre in zip(self.known, self.codes, centroids.T):
            table = (known[:, None] - centre[None, :]) ** 2
            far += table[codes]
        best = far.argmin(1)
        return best, far[np.arange(len(best)), best]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Sum of each cluster's vectors: the codes of each dimension counted, times their integers."""
        out = np.empty((k, len(self.known)), np.int64)
        for d, (known, codes) in enumerate(zip(self.known, self.codes)):
            counts = np.bincount(cluster * len(known) + codes, minlength=k * len(known)).reshape(k, len(known))
            out[:, d] = counts @ known
        return out


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, salt: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector kept.

    Kept are rows with a vec_id and exactly ``width`` components, none null or non-finite; a component x
    becomes the integer floor(``scale`` * x). Centroids start as the ``k`` vectors whose sha256 of
    "salt:vec_id" is smallest (fewer, if there are fewer); in each of ``rounds`` every vector goes to the
    nearest (ties: the smaller number), and every centroid that has vectors becomes their mean, rounded
    down by component; then vectors are assigned once more. Repeated rows count each; of rows with
    equal ids the smaller vector comes first. An empty table gives an empty result. Further columns are
    ignored. Components so large that a squared distance may exceed 64 bits are an error.
    """
    spark = rows.sparkSession
    # width squares of a difference of two such integers stay below 2^62.
    limit = 1 << (60 - width.bit_length()) // 2
    v = F.col("embedding").cast("array<double>")
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") == width) & vectors.finite(F.col("v")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vectors.slices(batches):
            sizes, known, codes = tables_of(vectors.floors(vectors.matrix(part, "v", width), scale, limit))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part.column(0).to_pylist(), pa.list_(pa.int64())), (sizes, pa.list_(pa.int32())), (known, pa.binary()), (codes, pa.binary()))], ["ids", "sizes", "known", "codes"])

    schema = "vec_id long, cluster int, distance long"
    first = own.orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256), "vec_id", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = vectors.floors(np.array([r["v"] for r in first]), scale, limit)
    blocks = shared.stored(own.mapInArrow(shared.tidy(pack), BLOCKS), "tables")

    for _ in range(rounds):

        def members(row: dict, centroids: np.ndarray = centroids) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            block = Block(row)
            best, _ = block.nearest(centroids)
            yield 0, np.bincount(best, minlength=len(centroids)), block.sums(best, len(centroids))

        centroids = centroids.copy()
        for (_, number), (n, total) in vectors.summed(blocks, members).items():
            centroids[number] = [s // n for s in total]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0])
                best, far = block.nearest(centroids)
                yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(best.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    assigned = shared.stored(blocks.mapInArrow(shared.tidy(assign), schema), "clusters")
    # One row a cluster comes to the driver.
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.element_at(F.create_map(*(F.lit(x) for n, value in values for x in (n, value))), F.col("cluster"))
    return assigned.select("*", of((n, s) for n, s in inertia.items()).cast("long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(enumerate(digest)).alias("centroid_sha256"))


def op12_scalar_tables(spark, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 16 clusters, by three rounds."""
    return cluster(shared.table(spark, sf_dir, "embeddings"))


def _sql(k: int = 16, rounds: int = 3) -> str:
    """The same by joins of vectors and centroids, component by component."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "e AS MATERIALIZED (SELECT row, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept)",
        f"c0 AS MATERIALIZED (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), vec_id, v) - 1 AS j, v FROM kept) WHERE j < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT row, min({{'s': s, 'j': j}}) AS b FROM (SELECT e.row, c.j, sum((e.x - c.x) * (e.x - c.x)) AS s FROM e JOIN c{i} c ON e.d = c.d GROUP BY e.row, c.j) GROUP BY row)")
        if i < rounds:
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.j, c.d, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT b.j AS j, d, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT) AS x FROM e JOIN a{i} USING (row) GROUP BY b.j, d) m ON c.j = m.j AND c.d = m.d)")
    last = f"SELECT vec_id, CAST(b.j AS INT) AS cluster, CAST(b.s AS BIGINT) AS distance, CAST(sum(b.s) OVER (PARTITION BY b.j) AS BIGINT) AS cluster_inertia, CAST(sum(b.s) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM kept JOIN a{rounds} USING (row) JOIN (SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY j) c ON b.j = c.j"
    return f"WITH {', '.join(steps)} {last}"


OP12_SQL = _sql()
