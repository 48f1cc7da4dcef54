"""Closures, inheritance and coverage on random input, against plain Python."""

from __future__ import annotations

import itertools
import random
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import joins


def breadth_first(edges, roots, stopped):
    """(depth, new id) of what is reached; edges: (src, dst, ord)."""
    out, level, depth = {}, [], 0
    for r in sorted(set(roots)):
        out[r] = (0, len(out))
        level.append(r)
    while level:
        depth += 1
        by = {}
        for s, d, o in edges:
            if s in level and d is not None and d not in stopped and d not in out:
                by[d] = min(by.get(d, (1 << 60, 0)), (out[s][1], o))
        level = sorted(by, key=lambda d: (by[d], d))
        for d in level:
            out[d] = (depth, len(out))
    return out


@pytest.mark.parametrize(("small", "large", "alone"), [(100_000, 1_000_000, 1_000_000), (3, 1_000_000, 3), (100_000, 5, 20)])
def test_closure_equals_breadth_first(spark, monkeypatch, small, large, alone):
    """Small levels, levels that are sorted over all tasks, and look-ups in buckets."""
    monkeypatch.setattr(joins, "SMALL_LEVEL", small)
    monkeypatch.setattr(joins, "LARGE_SET", large)
    monkeypatch.setattr(joins, "ONE_TASK", alone)
    rng = random.Random(small + large)
    edges = [(rng.randrange(60), rng.choice([*range(60), None]), o) for o in range(110)]
    roots, stopped = [3, 7, 3, None], {5, 11}
    df = spark.createDataFrame(edges, "src long, dst long, ord long")
    found = joins.reachable_objects(df, spark.createDataFrame([(r,) for r in roots], "id long"), F.col("id").isin(*stopped))
    assert {r.id: (r.depth, r.new_id) for r in found.collect()} == breadth_first(edges, [3, 7], stopped)


def test_a_chain_has_no_limit_and_a_cycle_ends(spark):
    """Every level is a round of its own."""
    n = 33
    edges = spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst")
    began = time.time()
    found = {r.id: (r.depth, r.new_id) for r in joins.reachable_objects(edges, spark.createDataFrame([(0,)], "id long"), F.lit(False)).collect()}
    assert found == {i: (i, i) for i in range(n)} and time.time() - began < 120


def test_nothing_to_reach(spark):
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert joins.reachable_objects(edges, spark.createDataFrame([], "id long"), F.lit(False)).count() == 0
    assert joins.reachable_objects(edges.limit(0), spark.createDataFrame([(9,)], "id long"), F.lit(False)).collect() == [(9, 0, 0)]


@pytest.mark.parametrize("limit", [0, 1, 2, 5, 64])
def test_inheritance_equals_a_walk(spark, limit):
    rng = random.Random(limit)
    parent = {i: rng.choice([None, i + 1, rng.randrange(90), 999]) for i in range(90)} | {i: i + 1 for i in range(100, 180)} | {180: None}
    value = {i: (i if rng.random() < 0.1 else None, f"v{i}" if rng.random() < 0.3 or i == 180 else None) for i in parent}

    def walk(i, a):
        for _ in range(limit + 1):
            if i not in value:
                return None
            if value[i][a] is not None:
                return value[i][a]
            i = parent[i]
        return None

    nodes = spark.createDataFrame([(i, p, *value[i]) for i, p in parent.items()], "id int, parent int, a int, b string")
    found = joins.inherit_attributes(nodes, ["a", "b"], limit).collect()
    assert {r.id: (r.a, r.b) for r in found} == {i: (walk(i, 0), walk(i, 1)) for i in parent} and len(found) == len(parent)


def split(text, coverage):
    out = []
    for i, c in enumerate(text):
        kind = unicodedata.category(c)
        after_control = out and out[-1][4]
        if kind in ("Mn", "Mc", "Me"):
            d, missing, control = (out[-1][2], out[-1][3], False) if out and not after_control else (1, False, False)
        else:
            d, missing, control = coverage.get(c, 1), c not in coverage, kind == "Cc"
        if out and not control and not after_control and (d, missing) == (out[-1][2], out[-1][3]):
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1, d, missing, control])
    return [tuple(r[:4]) for r in out]


def test_coverage_of_any_character_and_any_dictionary(spark):
    """Private-use characters, marks, controls, characters beyond 16 bits, dictionaries of large numbers."""
    rng = random.Random(18)
    alphabet = "ab中\ue000\ue102\uf0ff\U000f0001😀𝔘\n\t\x85\u0301\u0302\ufe0f é"
    pairs = [("a", 1), ("a", 9), ("b", 2050), ("中", 2_000_000_000), ("\ue102", 7), ("😀", 2050), ("𝔘", 3), ("\n", 4), ("\u0302", 6), (" ", 1), ("", 5), (None, 5), ("é", None)]
    coverage = {}
    for c, d in pairs:
        if c and d is not None:
            coverage[c] = min(d, coverage.get(c, d))
    texts = {i: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for i in range(300)} | {300: "", 301: None, 302: "\ue102", 303: "\u0301\u0301a"}
    found = {}
    for r in joins.coverage_split(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), spark.createDataFrame(pairs, "ch string, dict int")).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.end, r.dict, r.missing))
    assert {i: sorted(x) for i, x in found.items()} == {i: split(t, coverage) for i, t in texts.items() if t}


def test_coverage_without_dictionaries_or_texts(spark):
    none = spark.createDataFrame([], "ch string, dict int")
    texts = spark.createDataFrame([("x", "ab\n")], "doc_id string, text string")
    assert sorted(tuple(r) for r in joins.coverage_split(texts, none).collect()) == [("x", 0, 2, 1, True), ("x", 2, 3, 1, True)]
    assert joins.coverage_split(texts.limit(0), none).count() == 0


def test_texts_of_a_batch_are_split_in_parts(spark, monkeypatch):
    texts = spark.createDataFrame([(i, "a" * (i % 7) + "b" * 3) for i in range(50)], "doc_id int, text string").coalesce(1)
    coverage = spark.createDataFrame([("a", 1), ("b", 2)], "ch string, dict int")
    found = sorted((r.doc_id, r.start, r.end, r.dict) for r in joins.coverage_split(texts, coverage).collect())
    assert found == sorted(itertools.chain.from_iterable([(i, 0, i % 7, 1)] * (i % 7 > 0) + [(i, i % 7, i % 7 + 3, 2)] for i in range(50)))


def test_places_of_snippets_equal_a_search():
    rng = random.Random(12)
    for _ in range(300):
        ours = "".join(rng.choice("ab\U0001f600") for _ in range(rng.randrange(60)))
        reference = "".join(rng.choice([c, c, c, "a", ""]) for c in ours) if rng.random() < 0.9 else ours
        offsets, n = np.arange(len(reference) + 1), rng.choice([1, 3, 12])

        def search(o):
            part, want = reference[o : o + n], o if ours == reference else o * len(ours) / max(len(reference), 1)
            found = [i for i in range(len(ours) - len(part) + 1) if ours[i : i + len(part)] == part]
            return -2 if not part else min(found, key=lambda i: (abs(i - want), i), default=-1)

        assert joins._places(ours, reference, offsets, n) == [search(int(o)) for o in offsets]
