"""Vectors as short codes of parts: codebooks in integers, searched through the Walsh-Hadamard transform.

A part and the entries of its codebook are padded with zeros to a power of two and transformed by
signs alone. The transform keeps squared distances but for the factor of its length, and gathers what
is smooth in the first coefficients, ordered by their changes of sign (sequency). Squared differences
are added in that order: an entry whose sum exceeds the whole distance of an entry already measured is
out, long before all coefficients are read. All sums are integers, so nothing but the exact nearest
entry is left, and of equals the first.

Transformed parts are stored once. A round sends one row for each task, part and entry; sums of
transformed parts are transformed back, which is exact, before they are divided.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, vectors

#: Coefficients read before the first entries are out.
HEAD = 2


def sequency(n: int) -> np.ndarray:
    """Rows of the transform of length n (a power of two) in the order of their changes of sign."""
    signs = hadamard(np.eye(n, dtype=np.int64))
    return np.argsort((np.diff(signs, axis=1) != 0).sum(1), kind="stable")


def hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of the last axis (a power of two), in natural order, by sums and differences."""
    n, half = x.shape[-1], 1
    while half < n:
        pairs = x.reshape(*x.shape[:-1], n // (2 * half), 2, half)
        x = np.stack((pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]), axis=-2).reshape(x.shape)
        half *= 2
    return x


class Parts:
    """How vectors of a length are cut into equal parts and transformed."""

    def __init__(self, width: int, parts: int) -> None:
        self.parts, self.size = parts, width // parts
        self.padded = 1 << max(self.size - 1, 0).bit_length()
        self.order = sequency(self.padded)
        # Sums of squares of such differences stay below 2^62.
        self.limit = 1 << (59 - 3 * (self.padded.bit_length() - 1)) // 2
        self.kind = "<i4" if self.padded * self.limit < 1 << 31 else "<i8"

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers as [part, row, coefficient], in sequency order."""
        cut = x.reshape(len(x), self.parts, self.size).transpose(1, 0, 2)
        return hadamard(np.pad(cut, ((0, 0), (0, 0), (0, self.padded - self.size))))[..., self.order]

    def back(self, sums: list[int]) -> list[int]:
        """The sum of parts from the sum of their transforms, in integers of any size."""
        natural = np.empty(self.padded, object)
        natural[self.order] = sums
        return [int(s) // self.padded for s in hadamard(natural)][: self.size]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For transformed parts [row, coefficient] the nearest entry (the first of equals) and the scaled distance."""
    n = x.shape[1]
    sums = np.zeros((len(x), len(entries)), np.int64)
    for c in range(min(HEAD, n)):
        sums += (x[:, c, None] - entries[None, :, c]) ** 2
    # One entry measured to its end bounds the nearest from above.
    bound = ((x - entries[sums.argmin(1)]) ** 2).sum(1)
    row, entry = np.nonzero(sums <= bound[:, None])
    total = sums[row, entry]
    for c in range(HEAD, n):
        total = total + (x[row, c] - entries[entry, c]) ** 2
        left = total <= bound[row]
        row, entry, total = row[left], entry[left], total[left]
    # Rows and, within them, entries are still in their order.
    first = np.flatnonzero(np.diff(row, prepend=-1))
    best = np.minimum.reduceat(total, first) if len(first) else total
    equal = np.flatnonzero(total == np.repeat(best, np.diff(first, append=len(row))))
    return entry[equal[np.unique(row[equal], return_index=True)[1]]], best


def compress(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of each vector kept.

    Kept are rows with a vec_id whose vector has no null or non-finite component; a component x becomes
    the integer floor(``scale`` * x). Vectors are cut into ``parts`` equal parts, so only the most
    frequent length that parts divide (of equally frequent ones the larger) has codebooks; vectors
    of another length are left out. Each codebook starts as that part of the first ``entries`` vectors
    by vec_id (repeated ids: by vector); in each of ``rounds`` every part goes to the nearest entry
    (ties: the first), and every entry that is used becomes the mean of its parts, rounded down; then
    parts are assigned again. Repeated rows count each. Null labels are one label. An empty table gives
    an empty result; a table without ``label`` counts as one of null labels; further columns are ignored.
    Components so large that a squared distance may exceed 64 bits are an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold 256 entries at most")
    spark = rows.sparkSession
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("int")
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & vectors.finite(F.col("v")))
    kind = own.schema["label"].dataType.simpleString()
    lengths = [r for r in own.groupBy(F.size("v").alias("w")).count().collect() if r["w"] > 0 and r["w"] % parts == 0]
    if not lengths:
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string")
    width = max((r["count"], r["w"]) for r in lengths)[1]
    own, shape = own.where(F.size("v") == width), Parts(width, parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vectors.slices(batches):
            x = shape.forward(vectors.floors(vectors.matrix(part, "v", width), scale, shape.limit))
            lists = [pa.array([part.column(i).to_pylist()], pa.list_(part.schema.field(i).type)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([x.astype(shape.kind).tobytes()], pa.binary())], ["ids", "labels", "x"])

    def opened(row: dict) -> np.ndarray:
        return np.frombuffer(row["x"], shape.kind).astype(np.int64).reshape(parts, len(row["ids"]), shape.padded)

    first = own.orderBy("vec_id", "v").limit(entries).collect()
    start = vectors.floors(np.array([r["v"] for r in first]), scale, shape.limit)
    books = start.reshape(len(start), parts, shape.size).transpose(1, 0, 2).copy()  # [part, entry, component]
    blocks = shared.stored(own.mapInArrow(shared.tidy(pack), f"ids array<long>, labels array<{kind}>, x binary"), "parts")

    def transformed(books: np.ndarray) -> np.ndarray:
        return shape.forward(books.transpose(1, 0, 2).reshape(books.shape[1], width))

    for _ in range(rounds):

        def members(row: dict, marks: np.ndarray = transformed(books)) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for p, x in enumerate(opened(row)):
                entry, _ = nearest(x, marks[p])
                sums = np.zeros(marks[p].shape, np.int64)
                np.add.at(sums, entry, x)
                yield p, np.bincount(entry, minlength=len(marks[p])), sums

        books = books.copy()
        for (p, entry), (n, sums) in vectors.summed(blocks, members).items():
            books[p, entry] = [s // n for s in shape.back(sums)]

    marks = transformed(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1)
                row = block.to_pylist()[0]
                n, x = len(row["ids"]), opened(row)
                found = [nearest(x[p], marks[p]) for p in range(parts)]
                digits = np.stack([entry.astype(np.uint8) for entry, _ in found], 1).tobytes().hex()
                error = sum(far // shape.padded for _, far in found)
                codes = [digits[2 * parts * r : 2 * parts * (r + 1)] for r in range(n)]
                yield pa.RecordBatch.from_arrays([block.column(0).flatten(), block.column(1).flatten(), pa.array(codes), pa.array(error)], ["vec_id", "label", "code", "error"])

    coded = shared.stored(blocks.mapInArrow(shared.tidy(assign), f"vec_id long, label {kind}, code string, error long"), "codes")
    # One row a label; where labels are many, a hot one is split by the join.
    sums = shared.stored(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    of = shared.bounded(sums.withColumnRenamed("label", "_label"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(of, coded["label"].eqNullSafe(of["_label"])).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_walsh_codes(spark, sf_dir: str) -> DataFrame:
    """All vectors as codes of eight parts with sixteen entries each, by six rounds."""
    return compress(shared.table(spark, sf_dir, "embeddings"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same by plain distances of parts and entries; the width is that of the contract's tables."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"e AS MATERIALIZED (SELECT row, x, (d - 1) // (w // {parts}) AS p, (d - 1) % (w // {parts}) AS i FROM (SELECT row, unnest(v) AS x, generate_subscripts(v, 1) AS d, len(v) AS w FROM kept))",
        f"c0 AS MATERIALIZED (SELECT j, x, p, i FROM e JOIN (SELECT row, row_number() OVER (ORDER BY vec_id, v) - 1 AS j FROM kept) USING (row) WHERE j < {entries})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT row, p, min({{'s': s, 'j': j}}) AS b FROM (SELECT e.row, e.p, c.j, sum((e.x - c.x) * (e.x - c.x)) AS s FROM e JOIN c{n} c ON e.p = c.p AND e.i = c.i GROUP BY e.row, e.p, c.j) GROUP BY row, p)")
        if n < rounds:
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x, c.p, c.i FROM c{n} c LEFT JOIN (SELECT b.j AS j, p, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT) AS x FROM e JOIN a{n} USING (row, p) GROUP BY b.j, p, i) m ON c.j = m.j AND c.p = m.p AND c.i = m.i)")
    last = f"r AS (SELECT row, string_agg(printf('%02x', b.j), '' ORDER BY p) AS code, CAST(sum(b.s) AS BIGINT) AS error FROM a{rounds} GROUP BY row), h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, j, i)) AS h FROM c{rounds}) SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN r USING (row), h"
    return f"WITH {', '.join(steps)}, {last}"


OP13_SQL = _sql()
