"""Every registered query and every pipeline stage over a whole small table, against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from foliant.llm import labelled, nearest, piece_coder, quality, queries, shared

from .test_exact import brute_components, brute_removed, brute_spans, brute_windows, split_words
from .test_near_copies import brute_force as near_components


def read(sf_dir, name):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def texts(sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in read(sf_dir, "documents")}


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def rows(spark, sf_dir, name, n):
    df = queries.QUERIES[name](spark, sf_dir)
    out = df.collect()
    assert len(out) == n
    return {r.doc_id: r for r in out}


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize(("name", "parts", "rest", "column"), [("op1_nb_support_vectors", 5, 0, "quality"), ("op9_crf_toxicity", 4, 2, "toxic")])
def test_classifiers(spark, sf_dir, name, parts, rest, column):
    big = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r[column] for r in read(big, "labels") if r[column] is not None}
    ids = [r["doc_id"] for r in read(big, "documents")]
    found = rows(spark, big, name, len(ids))
    assert all(r.held_out == (fold(i, parts) == rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in found.items())
    held = [(found[i].score, y) for i, y in truth.items() if found[i].held_out]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros])
    assert len(held) > 50 and ones and zeros and auc >= (0.95 if column == "quality" else 0.8)


def test_labels_of_held_out_rows_are_not_learned_from(spark, sf_dir, tmp_path):
    """Turning their labels over changes no score."""
    import shutil

    for t in ("documents", "labels"):
        shutil.copyfile(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")  # not its mode: the tables are read-only
    for name, parts, rest in (("op1_nb_support_vectors", 5, 0), ("op9_crf_toxicity", 4, 2)):
        plain = {r.doc_id: r.score for r in queries.QUERIES[name](spark, sf_dir).collect()}
        own = read(sf_dir, "labels")
        for r in own:
            if fold(r["doc_id"], parts) == rest:
                r["quality"], r["toxic"] = 1 - r["quality"], 1 - r["toxic"]
        import pyarrow as pa

        pq.write_table(pa.Table.from_pylist(own), tmp_path / "labels.parquet")
        assert {r.doc_id: r.score for r in queries.QUERIES[name](spark, f"file://{tmp_path}").collect()} == plain


def test_shards(spark, sf_dir, texts):
    found = rows(spark, sf_dir, "op2_min_cost_flow_resharding", len(texts))
    size = lambda i: len(texts[i].encode()) + 8
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (size(i), zlib.crc32(texts[i].encode()), "bytes", None) for i, r in found.items())
    slots, sums = collections.defaultdict(list), collections.Counter({k: 0 for k in range(24)})
    for r in found.values():
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert set(sums) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums.values()) - min(sums.values()) <= max(map(size, texts))


def test_personal_data(spark, sf_dir, texts):
    found = rows(spark, sf_dir, "op3_disclosure_sanitiser", len(texts))
    for i, r in found.items():
        base = brute_spans(texts[i])
        shown = [f"{kind}:{s}:{e}" for s, _, e, kind in base]
        kinds = collections.Counter(b[3] for b in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == sha(",".join(shown))
        own = r.spans.split(",") if r.spans else []
        assert [s for s in own if not s.startswith("term:")] == shown and [int(s.split(":")[1]) for s in own] == sorted(int(s.split(":")[1]) for s in own)


def test_pieces(spark, sf_dir, texts, library):
    for i, r in rows(spark, sf_dir, "op4_sentencepiece_backtracking", len(texts)).items():
        ids = library.encode(texts[i])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_neighbours(spark, sf_dir):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in read(sf_dir, "embeddings") if r["embedding"] is not None}
    vectors = {i: v for i, v in vectors.items() if np.isfinite(v).all() and v.any()}
    found = collections.defaultdict(list)
    for r in queries.QUERIES["op5_stable_projection_search"](spark, sf_dir).collect():
        found[r.query_id].append(r)
    hits = total = 0
    assert set(found) == {i for i in vectors if i % 20 == 0}
    for q, own in found.items():
        own.sort(key=lambda r: r["rank"])
        best = sorted(((-float(v @ vectors[q]), i) for i, v in vectors.items() if i != q))[:20]
        assert [r["rank"] for r in own] == list(range(1, len(best) + 1))
        assert all(math.isclose(r.score, float(vectors[r.vec_id] @ vectors[q]), rel_tol=1e-9, abs_tol=1e-12) for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits, total = hits + len({r.vec_id for r in own} & {i for _, i in best}), total + len(best)
    assert hits / total >= 0.95


def test_vectors_of_several_lengths(spark):
    data = [(i, [1.0 + i, 2.0]) for i in range(5)] + [(10 + i, [1.0, 2.0, float(i)]) for i in range(3)]
    df = nearest.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    found = collections.defaultdict(list)
    for r in nearest.search(df, df, 20).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert found == {i: [j for j in reversed(range(5)) if j != i] for i in range(5)} | {10: [11, 12], 11: [12, 10], 12: [12 - 1, 10]}


def test_fingerprints_and_components(spark, sf_dir, texts):
    import xxhash

    def fingerprint(text):
        words = text.encode().translate(bytes([*range(65), *range(97, 123), *range(91, 256)])).split()
        parts = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t in texts.items()}
    expected = brute_components(prints, 2)
    found = rows(spark, sf_dir, "op6_simhash_tiles", len(texts))
    assert {i: (r.fingerprint, r.component_id) for i, r in found.items()} == {i: (f"{prints[i]:016x}", expected[i]) for i in texts}


def test_language_model(spark, sf_dir, texts):
    found = rows(spark, sf_dir, "op7_deleted_interpolation", len(texts))
    lower = bytes([*range(65), *range(97, 123), *range(91, 256)])
    tokens = {i: [*t.encode().translate(lower).split(), None] for i, t in texts.items()}
    counts = collections.Counter(w for i, w in tokens.items() if fold(i, 5) != 1 for w in w)
    n, v = sum(counts.values()), len(counts)
    for i, w in tokens.items():
        r = found[i]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 5) == 1, len(w), sum(x in counts for x in w), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_benchmark_windows(spark, sf_dir, texts):
    items = {r["item_id"]: r["text"] for r in read(sf_dir, "benchmark")}
    # Only texts that share a pair of words' five-word run with an item can have a window.
    runs = {tuple(w[k : k + 5]) for w in map(split_words, items.values()) for k in range(len(w) - 4)}
    near = {i: t for i, t in texts.items() if any(tuple(w[k : k + 5]) in runs for w in [split_words(t)] for k in range(len(w) - 4))}
    expected = brute_windows(near, items)
    assert all(len(split_words(t)) >= 10 for t in items.values()) and expected
    for i, r in rows(spark, sf_dir, "op8_positional_index", len(texts)).items():
        n_hit, own, n_near = expected.get(i, (0, [], 0))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.n_near) == (len(split_words(texts[i])), n_hit, len(own), sha(",".join(own)), n_hit > 0, n_near)


def test_recurring_passages(spark, sf_dir, texts):
    expected = brute_removed(texts, 35)
    found = rows(spark, sf_dir, "op10_repeated_phrase_automata", len(texts))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in found.items()} == {i: (n, gone, sha(kept)) for i, (n, gone, kept) in expected.items()}
    assert sum(r.n_removed for r in found.values())


def test_pipeline_stages(spark, sf_dir, texts, library):
    """Each stage on what the one before kept, held against a plain version of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def run(name, docs):
        path = shared.fresh_path(spark, "test-stage")
        stages[name](spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    def of(df):
        return {r.doc_id: r.text or "" for r in df.collect()}

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(labelled.fold("doc_id", 5) != 0).selectExpr("doc_id", "quality as label")
    model = quality.train(docs, labels)
    good = run("quality classifier", docs)
    score = dict(zip(texts, quality.score_texts(model, list(texts.values()))))
    assert of(good) == {i: t for i, t in texts.items() if score[i] >= 0.3}
    one = run("simhash near-dedup", good)
    own = of(good)
    groups = near_components(own)
    assert of(one) == {i: t for i, t in own.items() if groups[i] == i}
    clean = run("benchmark decontamination", one)
    hit = brute_windows({i: t for i, t in of(one).items()}, {r["item_id"]: r["text"] for r in read(sf_dir, "benchmark")})
    assert of(clean) == {i: t for i, t in of(one).items() if not hit.get(i, (0,))[0]}
    safe = run("pii", clean)
    from foliant.llm import pii

    before, after, touched = of(clean), of(safe), 0
    for r in pii.find(clean).collect():
        text = before[r.doc_id]
        spans = sorted([(m.s, m.e, f"[{list(pii.KINDS)[m.k].upper()}]") for m in r.base] + [(m.s, m.e, "" if m.a == "remove" else "[TERM]") for m in r.terms])
        out, at = "", 0
        for s, e, put in spans:
            if s >= at:
                out, at = out + text[at:s] + put, e
        assert after[r.doc_id] == out + text[at:]
        touched += bool(spans)
    assert after.keys() == before.keys() and not any(map(brute_spans, after.values())) and 0 < touched < len(after)
    final = {r.doc_id: r for r in run("sentencepiece", safe).collect()}
    assert final.keys() == after.keys()
    for i, t in after.items():
        ids = library.encode(t)
        assert (final[i].n_tokens, final[i].ids, final[i].decoded) == (len(ids), ids, library.decode(ids))
    assert np.frombuffer(piece_coder.PieceCoder(piece_coder.model_bytes()).encode("a b"), "<i4").tolist() == library.encode("a b")
