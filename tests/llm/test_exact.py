"""Operators whose results are exact, against brute force on small fixtures."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foliant.llm import blocks as B
from foliant.llm import decontaminate, interpolation, labelled, nearest, pii, piece_coder, reshard, shared, simhash, substrings

from . import odd


def rows_of(sf_dir, name):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


# --- SentencePiece


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(library, sf_dir):
    own = piece_coder.PieceCoder(piece_coder.model_bytes())
    rng = random.Random(5)
    texts = [r["text"] for r in rows_of(sf_dir, "documents")] + [t for _, t, *_ in odd.ROWS if t is not None]
    texts += ["".join(rng.choice("ab the▁ \n\t éß日😀\x00-_/.,ing") for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += [" " * 100, "▁" * 40, "<s> <unk> <0x0A>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    for t in texts:
        ids = library.encode(t)
        assert np.frombuffer(own.encode(t), "<i4").tolist() == ids, t[:80]
        assert own.decode(ids) == library.decode(ids), t[:80]


def test_decoding_of_any_ids(library):
    own = piece_coder.PieceCoder(piece_coder.model_bytes())
    rng = random.Random(6)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(rng.randint(1, 10))]
        assert own.decode(ids) == library.decode(ids), ids


def test_pieces_of_odd_documents(spark, library):
    found = piece_coder.encode(odd.docs(spark)).collect()
    assert sorted(r.doc_id for r in found) == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    texts = {i: t or "" for i, t, *_ in odd.ROWS}
    for r in found:
        assert r.ids == library.encode(texts[r.doc_id]) and r.decoded == library.decode(r.ids)
    assert piece_coder.encode(odd.empty(spark)).count() == 0
    back = piece_coder.decode(piece_coder.encode(odd.docs(spark))).collect()
    assert {r.doc_id: r.text for r in back}[4] == texts[4]


# --- SimHash


def brute_components(prints: dict[int, int], radius: int) -> dict[int, int]:
    ids = sorted(prints)
    near = {i: [j for j in ids if (prints[i] ^ prints[j]).bit_count() <= radius] for i in ids}
    out = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            least = min(out[j] for j in near[i])
            if least < out[i]:
                out[i], changed = least, True
    return out


def test_simhash_links_equal_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {i: v for i, v in enumerate(base)}
    for i in range(20, 400):
        v = prints[rng.randrange(i)]
        for _ in range(rng.choice([0, 1, 2, 2, 3, 5])):
            v ^= 1 << rng.randrange(64)
        prints[i] = v
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()], "doc_id long, fp long")
    for radius, parts, homes in ((0, 4, 1000), (3, 4, 1000), (2, 4, 3), (2, 8, 2)):
        groups = {r.fp & (2**64 - 1): r.component for r in simhash.link_components(df, radius, parts, homes).collect()}
        expected = brute_components(prints, radius)
        assert all(groups[v] == expected[i] for i, v in prints.items())


def test_simhash_fingerprint_by_definition():
    import xxhash

    text = "The quick BROWN fox\x0bjumps éÉ over the quick brown fox"
    words = re.split(r"[\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == expected
    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("a b") == xxhash.xxh64_intdigest("a b", 42)


def test_simhash_of_odd_documents(spark):
    found = simhash.near_duplicates(odd.docs(spark)).collect()
    groups = {r.doc_id: r.component_id for r in found}
    assert len(found) == 10 and groups[1] == groups[2] == groups[3] == 1 and groups[4] == groups[5] == 4
    kept = simhash.keep_one(odd.docs(spark))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7, 8, 9] and kept.columns == odd.docs(spark).columns
    assert simhash.near_duplicates(odd.empty(spark)).count() == 0


# --- Resharding


def test_flow_moves_the_fewest_bytes():
    supply, demand = [90, 10, 50], [40, 30, 40, 40]
    flow = reshard.min_cost_flow(supply, demand)
    assert [sum(b for i, _, b in flow if i == k) for k in range(3)] == supply
    assert [sum(b for _, j, b in flow if j == k) for k in range(4)] == demand
    assert sum(b for i, j, b in flow if i != j) == sum(max(0, s - d) for s, d in zip(supply, demand))


def test_reshard_balances_and_numbers_slots(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old = F.pmod(F.xxhash64("source"), F.lit(4)).cast("int")
    out = reshard.reshard(docs, old, 4, 6, f"file://{tmp_path}/a").toPandas()
    texts = {r["doc_id"]: r["text"] for r in rows_of(sf_dir, "documents")}
    assert dict(zip(out.doc_id, out.text)) == texts
    sizes = out.text.map(lambda t: len(t.encode()) + 8).groupby(out["shard"]).sum()
    assert sizes.max() - sizes.min() <= max(len(t.encode()) + 8 for t in texts.values())
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_only_affected_shards_are_written(spark, tmp_path):
    """Of four shards two are as they should be: their folders are not written, and the fewest bytes move."""
    import os

    of = {i: 0 if i < 10 else 1 if i < 20 else 2 if i < 35 else 3 for i in range(40)}
    docs = spark.createDataFrame([(i, f"{i:050}", s) for i, s in of.items()], "doc_id long, text string, old int")
    cuts, transfers = reshard.plan(docs, F.col("old"), 4, 4)
    assert sorted((a, b) for a, b, n in transfers if a != b and n) == [(2, 3)]
    out = reshard.reshard(docs, F.col("old"), 4, 4, f"file://{tmp_path}/part", affected_only=True).collect()
    assert {n for n in os.listdir(tmp_path / "part") if n.startswith("shard=")} == {"shard=2", "shard=3"}
    assert {r.doc_id for r in out} == set(range(20, 40)) and all(r.text == f"{r.doc_id:050}" for r in out)
    moved = [r for r in out if r.shard != of[r.doc_id]]
    assert len(moved) == 5 and 58 * len(moved) == sum(n for a, b, n in transfers if a != b)
    for s in (2, 3):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(10))
    whole = reshard.reshard(docs, F.col("old"), 4, 4, f"file://{tmp_path}/whole").collect()
    assert {(r.doc_id, r.shard) for r in whole} == {(r.doc_id, r.shard) for r in out} | {(i, s) for i, s in of.items() if s < 2}


def test_more_files_than_the_least_number(spark, tmp_path):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('x', 90) AS text")
    out = reshard.reshard(docs, F.lit(0), 1, 2, f"file://{tmp_path}/files", file_bytes=2_000)
    files = [f for _, _, names in __import__("os").walk(tmp_path / "files") for f in names if f.endswith(".parquet")]
    assert len(files) > 2 * 4
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(400))
    for s in (0, 1):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_reshard_of_odd_documents(spark, tmp_path):
    out = reshard.reshard(odd.docs(spark), F.lit(0), 1, 3, f"file://{tmp_path}/b").collect()
    assert len(out) == len(odd.ROWS) and {r.shard for r in out} <= {0, 1, 2}
    assert reshard.reshard(odd.empty(spark), F.lit(0), 1, 3, f"file://{tmp_path}/c").count() == 0


# --- PII

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(text: str) -> list[tuple[int, int, int, str]]:
    def luhn(d: str) -> bool:
        return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_plain_patterns(spark, sf_dir):
    rng = random.Random(8)
    texts = [r["text"] for r in rows_of(sf_dir, "documents")]
    texts += ["a@b.cc+x@d.ee", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255", "..%a@b.c.d-e a@b a@b.", "+1 (555) 010-99999 +12 +1234567890123456", "4111 1111 1111 1111x 4111-1111-1111-1112", "9" * 3000 + "@", "a." * 3000 + "@b.c", "1-" * 2000, "+" * 50 + "1" + " " * 2000, "😀é a@b.co 1.1.1.1"]
    texts += ["".join(rng.choice("a1.@+- 45()") for _ in range(60)) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in df.select("text", pii.base_spans(F.col("text")).alias("b")).collect():
        assert [(m.s, m.k, m.e) for m in r.b] == [x[:3] for x in brute_spans(r.text)], r.text[:80]


def test_pii_of_odd_documents(spark):
    found = pii.find(odd.docs(spark))
    assert {r.doc_id: len(r.base) for r in found.collect()}[7] == 4 and found.count() == 10
    out = pii.sanitise(odd.docs(spark), found)
    assert out.columns == odd.docs(spark).columns and out.count() == len(odd.ROWS)
    assert pii.find(odd.empty(spark)).count() == 0


# --- Nearest neighbours


def test_nearest_reaches_the_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    x[100:400] = x[7]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] * 16), (9004, [1.0]), (None, [1.0] * 16), (5, x[5].tolist())]
    df = nearest.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({"cell": F.lit("clash"), "f": F.lit(1), "kth": F.lit(2)}))
    assert df.count() == 3001
    asked = df.where("vec_id % 20 = 0")
    # In one cell; in cells fitted on all; in blocks of cells fitted on a few.
    for sample, block in ((50_000, 16_384), (50_000, 200), (100, 150)):
        found = nearest.search(df, asked, 20, sample=sample, block=block).toPandas()
        hits = total = 0
        for q, g in found.groupby("query_id"):
            score = (x * x[q]).sum(1)
            order = [i for i in np.lexsort((np.arange(3000), -score)) if i != q][:20]
            own = g.sort_values("rank")
            hits, total = hits + len(set(own.vec_id) & set(order)), total + 20
            assert np.allclose(own.score, score[own.vec_id]) and list(own["rank"]) == list(range(1, 21))
        assert found.query_id.nunique() == 150 and hits / total >= 0.95
        by_rank = found.sort_values(["query_id", "rank"])
        assert list(by_rank.vec_id) == list(found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).vec_id)
        assert (by_rank.query_id != by_rank.vec_id).all()
    assert nearest.search(df.limit(0), df, 5).count() == 0 and nearest.search(df, df.limit(0), 5).count() == 0


def test_one_vector_counts_for_an_id(spark):
    rows = [(1, [2.0, 0.0]), (1, [1.0, 5.0]), (1, [1.0, 5.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])]
    df = nearest.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted((r.vec_id, r.embedding) for r in df.collect()) == [(1, [1.0, 5.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])]
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.search(df, df, 2).collect())
    assert found == [(1, 1, 2, 6.0), (1, 2, 3, 5.0), (2, 1, 1, 6.0), (2, 2, 3, 1.0), (3, 1, 1, 5.0), (3, 2, 2, 1.0)]


def test_cells_hold_every_point_once():
    rng = np.random.default_rng(4)
    points = np.r_[rng.standard_normal((500, 3)), np.zeros((200, 3)), rng.integers(0, 2, (100, 3))]
    nodes = nearest.kd_cells(points, 20)
    cells = nearest.cell_of(nodes, points)
    assert len(np.unique(cells)) == len(nodes) + 1 and np.bincount(cells).max() >= 200 and np.median(np.bincount(cells)) <= 20


def test_chi_square_distribution():
    assert abs(float(nearest.chi_square(np.array([7.344]))[0]) - 0.5) < 1e-3 and abs(float(nearest.chi_square(np.array([15.507]))[0]) - 0.95) < 1e-3


# --- Recurring passages


def brute_removed(texts: dict[int, str], width: int) -> dict[int, tuple[int, int, str]]:
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    seen = collections.Counter(tuple(w[s : s + width]) for w in words.values() for s in range(len(w) - width + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if seen[tuple(w[s : s + width])] > 1:
                gone[s : s + width] = [True] * width
        out[i] = len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()
    return out


def test_recurring_windows_equal_brute_force(spark):
    rng = random.Random(4)
    texts = {}
    shared_part = [rng.choice("abcd") for _ in range(60)]
    for i in range(80):
        own = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(0, 120))]
        at = rng.randint(0, len(own))
        cut = rng.randint(0, 60)
        texts[i] = " ".join(own[:at] + (shared_part[cut : cut + rng.randint(20, 60)] if i % 3 == 0 else []) + own[at:])
    texts[80], texts[81] = "the " * 100, texts[3]
    texts[82] = " ".join(str(k) for k in range(35))
    texts[83] = texts[82] + " tail"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for width in (35, 12):
        found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_recurring(df, width).collect()}
        assert found == brute_removed(texts, width)


def thue_morse() -> tuple[str, str]:
    """Two words that polynomial hashes modulo a power of two cannot tell apart."""
    bits = [k.bit_count() % 2 for k in range(1024)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_recurring_windows_of_split_shards(spark, monkeypatch):
    """Small blocks, each shard split over many tasks; passages shared by many blocks and within one."""
    monkeypatch.setattr(B, "BLOCK_BYTES", 2_000)
    rng = random.Random(14)
    lines = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(50)) for _ in range(6)]
    texts = {i: " ".join(rng.choice(lines) if rng.random() < 0.5 else f"own{i} word{rng.random()}" for _ in range(rng.randint(1, 9))) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for salt_bytes in (1, 500, 1 << 20):
        found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_recurring(df, 35, salt_bytes).collect()}
        assert found == brute_removed(texts, 35)


def test_different_windows_are_never_removed(spark):
    one, two = thue_morse()
    texts = {i: " ".join(w if k == 17 else f"w{k}" for k in range(35)) for i, w in enumerate((one, two))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert [r.n_removed for r in substrings.remove_recurring(df).collect()] == [0, 0]


def test_shards_compare_words_whatever_the_hashes_say(monkeypatch, spark):
    """With equal hashes for all windows, only what stands there twice is removed."""
    monkeypatch.setattr(substrings.Block, "long", lambda self, places: np.full(len(places), 7, np.uint64))
    common = " ".join(f"c{k}" for k in range(40))
    texts = {0: common, 1: common + " tail", 2: " ".join(f"c{k}" for k in range(18)) + " " + " ".join(f"d{k}" for k in range(30))}
    shard = substrings.Shard([texts[0].encode()], [1], 35, 18)
    assert list(shard.locate(texts[1].encode(), True)) == list(range(6)) and not len(shard.locate(texts[2].encode(), True))
    assert list(shard.recurring(texts[0].encode())) == list(range(6))


@pytest.mark.parametrize("space", [1, 7, 40])
def test_words_that_share_a_code_are_told_apart(space):
    """With fewer code points than words the automaton finds too much, but nothing else is taken."""
    rng = random.Random(space)
    own = [" ".join(f"w{rng.randrange(60)}" for _ in range(90)).encode() for _ in range(4)]
    own.append(own[0])
    alike = [" ".join(w if rng.random() < 0.97 else f"x{w}" for w in t.decode().split(" ")).encode() for t in own]
    small, large = substrings.Shard(own, [1] * 5, 35, 18, space), substrings.Shard(own, [1] * 5, 35, 18)
    assert small.shared and not large.shared
    for t in [*alike, *own, b" ".join(own)]:
        assert list(small.locate(t, True)) == list(large.locate(t, True))
    for t in own:
        assert list(small.recurring(t)) == list(large.recurring(t))


def test_blocks_without_any_answer(spark):
    """Only short texts: no block asks for anything, and every word is kept."""
    df = spark.createDataFrame([(i, "a b c" if i else None) for i in range(5)], "doc_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_recurring(df).collect()}
    assert found[0] == (0, 0, "") and all(found[i] == (3, 0, "a b c") for i in range(1, 5))


def test_recurring_of_odd_documents(spark):
    found = substrings.remove_recurring(odd.docs(spark)).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 10 and by_id[6].n_removed == 30_000 and by_id[6].kept == "" and by_id[4].n_removed == 0 and by_id[1].n_words == 0
    assert substrings.remove_recurring(odd.empty(spark)).count() == 0


# --- Decontamination


def split_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_windows(texts: dict[int, str], items: dict[int, str], width: int = 10, slop: int = 2) -> dict[int, tuple[int, list[str], int]]:
    """n_hit, items, near of the texts that have any of them."""
    out = {}
    for i, t in texts.items():
        w, hit, its, near = split_words(t), set(), set(), set()
        for k, item in items.items():
            v = split_words(item)
            for s in range(max(len(v) - width + 1, 1) if v else 0):
                win = v[s : s + width]
                halves = ((0, 5), (5, 10)) if len(win) == 10 else ((0, len(win)),)
                for p in range(-len(win), len(w)):
                    if p >= 0 and w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        its.add(str(k))
                        near.add(k)
                    for a, b in halves:
                        if p + a >= 0 and w[p + a : p + b] == win[a:b]:
                            lost = sum(win[x] not in w[max(p + x - slop, 0) : max(p + x + slop + 1, 0)] for x in range(len(win)) if not a <= x < b)
                            if lost <= 1:
                                near.add(k)
        if near:
            out[i] = len(hit), sorted(its), len(near)
    return out


def found_windows(docs, bench):
    return {r.doc_id: (r.n_hit, r["items"], r.near) for r in decontaminate.measure(docs, bench).collect() if r.near}


@pytest.mark.parametrize("limit", [100, 0])
def test_windows_equal_brute_force(spark, monkeypatch, limit):
    """With broadcasts of a few rows, and with none: the same result."""
    monkeypatch.setattr(shared, "small", lambda df, _=None: limit > 0 and df.limit(limit).count() < limit)
    rng = random.Random(9)
    vocabulary = ["the", "of", "alpha", "beta", "Gamma", "delta7", "é", "rare"]
    items = {k: " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 9, 10, 14]))) for k in range(25)}
    items[25], items[26] = None, "!!"
    texts = {}
    for i in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 4 == 0:
            own += re.findall(r"\w+", items[i % 25] or "") + ["end"]
        texts[i] = rng.choice([" ", "--", ", "]).join(own)
    texts[60] = None
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string").withColumns({"w": F.lit("clash"), "win": F.lit(1), "phrase": F.lit(2)})
    expected = brute_windows(texts, items)
    assert found_windows(docs, bench) == expected
    assert {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()} == set(texts) - {i for i, x in expected.items() if x[0]}


def test_proximity_finds_windows_with_one_word_altered(spark):
    item = "uno dos tres cuatro cinco seis siete ocho nueve diez"
    texts = {1: item, 2: item.replace("cinco", "cinco extra"), 3: "uno " + "x " * 30 + "diez", 4: None, 5: item.replace("dos", "altered"), 6: item.replace("nueve ", ""), 7: item.replace("siete", "altered").replace("uno", "changed"), 8: "uno dos tres cuatro cinco"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = found_windows(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert found == brute_windows(texts, {1: item}) == {1: (10, ["1"], 1)} | {i: (0, [], 1) for i in (2, 5, 6)}


def test_decontamination_of_odd_documents(spark):
    bench = spark.createDataFrame([(1, "two three four"), (2, None)], "item_id long, text string")
    found = decontaminate.measure(odd.docs(spark), bench).collect()
    assert len(found) == 10 and {r.doc_id: r.n_hit for r in found if r.n_hit} == {4: 3, 5: 3} and {r.doc_id: r.n_words for r in found}[6] == 30_000
    assert decontaminate.measure(odd.empty(spark), bench).count() == 0
    assert {r.n_hit for r in decontaminate.measure(odd.docs(spark), bench.limit(0)).collect()} == {0}
    assert decontaminate.keep_clean(odd.docs(spark), bench).columns == odd.docs(spark).columns


def test_rows_of_one_id_keep_their_own_hits(spark):
    docs = spark.createDataFrame([(5, "one two three four"), (5, "nothing"), (5, "one two three four")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    assert sorted((r.n_words, r.n_hit) for r in decontaminate.measure(docs, bench).collect()) == [(1, 0), (4, 2), (4, 2)]
    assert [r.text for r in decontaminate.keep_clean(docs, bench).collect()] == ["nothing"]


# --- Language model


def test_base_score_and_interpolation(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in rows_of(sf_dir, "documents")} | {i + 10_000: t for i, t, *_ in odd.ROWS if i and i != 5}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in interpolation.log_scores(df, labelled.fold("doc_id", 5) != 1).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = collections.Counter(w for i in train for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, w in tokens.items():
        r = found[i]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), n) and abs(r.base_score - base) < 1e-6 * abs(base)
    held = [r for i, r in found.items() if i not in set(train)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_interpolation_is_a_distribution(spark):
    """The probabilities of all texts, one unknown type included, add up to one."""
    train = [(i, t) for i, t in enumerate(["a b a c", "a b b", "c a b", "b a"] * 6)]
    texts = [" ".join(t) for n in range(7) for t in itertools.product("abcz", repeat=n)]
    df = spark.createDataFrame(train + [(1000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: 10**r.score for r in interpolation.log_scores(df, F.col("doc_id") < 1000).collect()}
    by_length = np.zeros(7)
    for k, t in enumerate(texts):
        by_length[len(t.split())] += found[1000 + k]
    # Longer texts go on falling at the last rate of two steps.
    rate = by_length[5:].sum() / by_length[3:5].sum()
    assert by_length.sum() < 1 and abs(by_length.sum() + by_length[5:].sum() * rate / (1 - rate) - 1) < 2e-3


def test_scores_of_large_ids_and_of_words_that_polynomials_confuse(spark):
    train = [(2**62 + 5, "a b a"), (-(2**63), "a b")] + [(i, "b a b") for i in range(5)]
    one, two = thue_morse()
    df = spark.createDataFrame(train + [(7, one), (8, two)], "doc_id long, text string")
    found = {r.doc_id: r for r in interpolation.log_scores(df, F.col("doc_id") != 8).collect()}
    assert found.keys() == {2**62 + 5, -(2**63), *range(5), 7, 8}
    assert found[7].n_known == 2 and found[8].n_known == 1 and found[8].train_tokens == 4 + 3 + 5 * 4 + 2


def test_language_model_without_training_or_rows(spark):
    df = odd.docs(spark)
    found = interpolation.log_scores(df, F.lit(False)).collect()
    assert len(found) == 10 and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in found)
    assert interpolation.log_scores(odd.empty(spark), F.lit(True)).count() == 0


def test_expectation_maximisation_prefers_the_pair_where_it_holds():
    import pandas as pd

    code = lambda n: int(interpolation._round(np.array([n]))[0])
    often = pd.DataFrame({"pair": [50], "context": [code(64)], "word": [code(60)], "n": [5000]})
    never = pd.DataFrame({"pair": [1], "context": [code(1)], "word": [code(500)], "n": [800]})
    often, never = (interpolation.expectation_maximisation(x, 10_000, 500) for x in (often, never))
    assert np.allclose([often.sum(), never.sum()], 1) and often[0] > 0.8 and never[0] == 0


def test_shared_folder_is_the_sessions(spark):
    assert shared.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
