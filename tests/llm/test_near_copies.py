"""The near-dedup stage of the pipeline against brute force over sets of five-word shingles."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from foliant.llm import near_copies

from . import odd


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_force(texts):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and similar(sets[a], sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_near_copies_equal_brute_force(spark, sf_dir):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.choice([5, 9, 30, 200, 900]))
        for _ in range(10):
            copy = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts[len(texts) + 1] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = brute_force(texts)
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()}
    assert found == expected
    kept = corpus_pipeline.drop_near_duplicates(spark, df, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


@pytest.mark.parametrize("shingles", [4_000_000, 3_000])
def test_later_rounds_compare_what_the_first_left(spark, monkeypatch, shingles):
    """In one block of a tile, and in several."""
    monkeypatch.setattr(near_copies, "BESIDE", 1)
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", shingles)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for k in range(60):
        copy = list(words)
        for _ in range(rng.randint(5, 10)):
            copy[rng.randrange(len(copy))] = f"x{rng.random()}"
        texts[k] = " ".join(copy)
    found = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == brute_force(texts)


def test_links_of_a_block_join_all_that_is_similar():
    """Whatever the order, the components are those of all pairs."""
    rng = random.Random(8)
    base = rng.sample(range(10_000), 120)
    own = [sorted({x if rng.random() < 0.9 else rng.randrange(10_000) for x in base}) for _ in range(80)]
    sets = [np.array(s, np.uint64) for s in own]
    n, zero = np.array([len(s) for s in sets]), np.zeros(80, np.uint64)
    component = np.arange(80)
    component[40:50] = 40
    links = near_copies.joined(n, zero, zero, component, sets, 0, 0.8)
    assert all(similar(set(own[a]), set(own[b])) for a, b in links)

    def grouped(links):
        root = component.copy()
        for a, b in links:
            root[root == root[b]] = root[a]
        return {frozenset(np.flatnonzero(root == r).tolist()) for r in root}

    every = [(a, b) for a in range(80) for b in range(a) if similar(set(own[a]), set(own[b]))]
    assert every and grouped(links) == grouped(every) and len(links) < 80
    assert near_copies.crossing(n, zero, zero, component, 0, 0.8).all() and not near_copies.crossing(n[:0], zero[:0], zero[:0], component[:0], 0, 0.8).any()


@pytest.mark.parametrize("homes", [65_536, 7])
def test_candidates_are_simhash_groups_of_all_pairs(spark, monkeypatch, homes):
    """Tiles of fingerprints, whole or in blocks, find what comparing all fingerprints finds."""
    monkeypatch.setattr(near_copies, "HOMES_PER_TILE", homes)
    rng = random.Random(5)
    rows = []
    for base in range(30):
        bits, n = rng.getrandbits(256), rng.choice([4, 5, 40, 41, 50, 300])
        for _ in range(5):
            marked = bits
            for b in rng.sample(range(256), rng.choice([3, 20, 45, 70])):
                marked ^= 1 << b
            size = max(4, n * rng.randint(80, 125) // 100)
            rows.append((len(rows) * 7 - 400, size, marked))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    parts = lambda x, bits: bin(x & ((1 << bits) - 1)).count("1")
    df = spark.createDataFrame([(k, n, *(signed(f >> 64 * i & (1 << 64) - 1) for i in range(4))) for k, n, f in rows], "node long, n int, f0 long, f1 long, f2 long, f3 long")
    root = {k: k for k, _, _ in rows}
    for a, na, fa in rows:
        for b, nb, fb in rows:
            x = fa ^ fb
            if a < b and 5 * min(na, nb) >= 4 * max(na, nb) and parts(x, 64) <= near_copies.FIRST and parts(x, 128) <= near_copies.RADIUS and parts(x, 256) <= near_copies.WHOLE:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    linked = {k: r for k, r in root.items() if list(root.values()).count(r) > 1}
    found = {r.node: r.key for r in near_copies.simhash_groups(df, len(rows), near_copies.RADIUS, near_copies.SIMILARITY).collect()}
    assert found == linked and 20 < len(linked) < len(rows)


def test_near_copies_of_odd_documents(spark):
    found = near_copies.near_copies(odd.docs(spark)).collect()
    assert sorted(r.doc_id for r in found) == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    assert near_copies.keep_one(odd.docs(spark)).columns == odd.docs(spark).columns
    assert near_copies.near_copies(odd.empty(spark)).count() == 0
