"""Clusters by tables and codes by transforms, against plain Python and against DuckDB."""

from __future__ import annotations

import collections
import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from foliant.llm import queries, scalar_tables, vectors, walsh_codes

from ..test_oracles import normal

INF, NAN = float("inf"), float("nan")


def kept(rows, width=None):
    return [r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and (width is None or len(r[1]) == width)]


def lloyd(points, centres, rounds):
    """Rounds of assignment and floored means; the final assignment and centres."""

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = collections.defaultdict(list)
        for p in points:
            own[nearest(p)[1]].append(p)
        centres = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else c for j, c in enumerate(centres)]
    return [nearest(p) for p in points], centres


def brute_clusters(rows, k, rounds, width, scale):
    rows = kept(rows, width)
    whole = [[math.floor(scale * x) for x in v] for _, v, *_ in rows]
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    found, centres = lloyd(whole, [whole[i] for i in order[:k]], rounds)
    each = collections.Counter()
    for d, j in found:
        each[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((r[0], j, d, each[j], sum(each.values()), digest[j]) for r, (d, j) in zip(rows, found))


def brute_codes(rows, parts, entries, rounds, scale):
    rows = sorted(kept(rows), key=lambda r: (r[0], r[1]))
    width = max((n, w) for w, n in collections.Counter(len(r[1]) for r in rows).items() if w and w % parts == 0)[1]
    rows = [r for r in rows if len(r[1]) == width]
    size, books, codes, errors = width // parts, [], [""] * len(rows), [0] * len(rows)
    for p in range(parts):
        cut = [[math.floor(scale * x) for x in r[1][p * size : (p + 1) * size]] for r in rows]
        found, book = lloyd(cut, cut[:entries], rounds)
        books += [x for e in book for x in e]
        for i, (d, j) in enumerate(found):
            codes[i] += f"{j:02x}"
            errors[i] += d
    label = collections.Counter()
    for r, e in zip(rows, errors):
        label[r[2]] += e
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted((r[0], str(r[2]), c, e, label[r[2]], digest) for r, c, e in zip(rows, codes, errors))


def table(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({c: F.lit("clash") for c in ("cluster", "distance", "ids", "codes", "v", "x", "code", "error", "_label", "n")})


def some(rng, n, width, copies=0):
    """Vectors around few centres, equal ones among them, and what must be left out."""
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(5)]
    exact = lambda x: float(np.float32(x))
    rows = [(i, [exact(x + rng.gauss(0, 0.1)) for x in rng.choice(centres)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(1000 + i, rows[0][1], 7) for i in range(copies)]
    odd = [(None, rows[1][1], 1), (2000, None, 1), (2001, [], None), (2002, [NAN] * width, 1), (2003, [INF] + [0.0] * (width - 1), 1), (2004, [None] * width, 1), (2005, [0.5] * (width + 1), 2), (3, rows[3][1], 2), (4, rows[5][1], None)]
    rows += odd
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "width", "k", "rounds"), [(200, 6, 16, 3), (5, 4, 16, 2), (60, 3, 4, 0)])
def test_clusters_equal_brute_force(spark, n, width, k, rounds):
    rows = some(random.Random(n), n, width, copies=30)
    found = scalar_tables.cluster(table(spark, rows).repartition(3), k, rounds, width, 64).collect()
    assert sorted(map(tuple, found)) == brute_clusters(rows, k, rounds, width, 64)


@pytest.mark.parametrize(("n", "width", "parts", "entries", "rounds"), [(200, 16, 2, 16, 6), (40, 9, 3, 4, 3), (6, 10, 2, 16, 2), (30, 4, 4, 5, 2)])
def test_codes_equal_brute_force(spark, n, width, parts, entries, rounds):
    rows = some(random.Random(n), n, width, copies=20)
    found = walsh_codes.compress(table(spark, rows).repartition(3), parts, entries, rounds, 4096).collect()
    assert sorted((r.vec_id, str(r.label), r.code, r.error, r.label_error, r.codebooks_sha256) for r in found) == brute_codes(rows, parts, entries, rounds, 4096)


def test_slices_hold_every_row_once():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"i": list(range(a, b))}) for a, b in ((0, 10), (10, 10), (10, 13))]
    parts = [p.column(0).to_pylist() for p in vectors.slices(iter(batches), 4)]
    assert parts == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], [10, 11, 12]]


def test_nothing_kept(spark):
    for rows in ([], [(1, None, 1), (2, [NAN] * 64, 2), (None, [0.0] * 64, 3)]):
        assert scalar_tables.cluster(table(spark, rows)).collect() == []
        assert walsh_codes.compress(table(spark, rows)).collect() == []
    columns = scalar_tables.cluster(table(spark, [])).dtypes
    assert columns == scalar_tables.cluster(table(spark, [(1, [0.5] * 64, 1)])).dtypes
    assert walsh_codes.compress(table(spark, [])).dtypes == walsh_codes.compress(table(spark, [(1, [0.5] * 64, 1)])).dtypes
    assert walsh_codes.compress(table(spark, [(1, [0.5] * 64, 1)]).select("vec_id", "embedding")).first().label is None


def test_components_too_large_are_an_error(spark):
    rows = table(spark, [(1, [3e30] + [0.0] * 63, 1)])
    for run in (scalar_tables.cluster, walsh_codes.compress):
        with pytest.raises(Exception, match="64 bits"):
            run(rows).collect()


def test_transform_keeps_distances_and_orders_by_changes_of_sign():
    rng = np.random.default_rng(4)
    for n in (1, 2, 8, 32):
        x = rng.integers(-1000, 1000, (7, n))
        h = walsh_codes.hadamard(x)
        assert (((h[:1] - h) ** 2).sum(1) == n * ((x[:1] - x) ** 2).sum(1)).all() and (walsh_codes.hadamard(h) == n * x).all()
        rows = walsh_codes.hadamard(np.eye(n, dtype=np.int64))[walsh_codes.sequency(n)]
        assert [int((np.diff(r) != 0).sum()) for r in rows] == list(range(n))


def test_elimination_is_exact():
    """Against all distances, with many ties."""
    rng = np.random.default_rng(5)
    for n, high in ((8, 3), (8, 1 << 20), (1, 4), (16, 2)):
        x, e = walsh_codes.hadamard(rng.integers(-high, high, (500, n))), walsh_codes.hadamard(rng.integers(-high, high, (16, n)))
        far = ((x[:, None] - e[None]) ** 2).sum(2)
        entry, best = walsh_codes.nearest(x, e)
        assert (entry == far.argmin(1)).all() and (best == far.min(1)).all()


def test_tables_tell_wide_dictionaries_apart():
    rng = np.random.default_rng(6)
    for high in (50, 100_000):
        x = rng.integers(-high, high, (900, 3))
        block = scalar_tables.Block(dict(zip(("ids", "sizes", "known", "codes"), (list(range(900)), *scalar_tables.tables_of(x)))))
        c = rng.integers(-high, high, (5, 3))
        far = ((x[:, None] - c[None]) ** 2).sum(2)
        best, distance = block.nearest(c)
        assert (best == far.argmin(1)).all() and (distance == far.min(1)).all()
        assert (block.sums(best, 5) == np.stack([x[best == j].sum(0) for j in range(5)])).all()


@pytest.mark.parametrize("name", ["op12_scalar_tables", "op13_walsh_codes"])
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    expected = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns) and normal(df.collect(), df.columns) == normal(expected.fetchall(), columns)
