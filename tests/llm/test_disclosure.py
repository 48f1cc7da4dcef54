"""Disclosing terms: degrees by brute force, secrets beside their cues, repeated rows and copies."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.llm import pii, shared

from .test_exact import brute_spans

REACH, SMOOTHING = 2, 8.0


def term_of(word: str) -> str:
    if not re.search("[0-9]", word):
        return word
    return f"#{'a' if re.search('[^0-9]', word) else ''}9:{int(math.log2(len(word)))}"


def brute_degrees(texts: list[str]) -> dict[str, float]:
    """Degree of every term over different texts."""
    near, all_places, total = collections.Counter(), collections.Counter(), 0
    for text in dict.fromkeys(t or "" for t in texts):
        marked, at = "", 0
        for s, k, e, _ in brute_spans(text):
            if s >= at:
                marked += text[at:s] + f" {'abcd'[k]} "
                at = e
        marked += text[at:]
        words = re.findall(r"[abcd]|[^\W_]+", marked.lower())
        plain = re.findall(r"[^\W_]+", text.lower())
        total += len(plain)
        all_places.update(map(term_of, plain))
        classes = [w[1] if w[0] == "" else "credential" if w in pii.CONCEPTS else None for w in words]
        for p, w in enumerate(words):
            if classes[p] is None:
                near.update((c, term_of(w)) for c in {c for c in classes[max(p - REACH, 0) : p + REACH + 1] if c})
    size = collections.Counter()
    for (c, _), n in near.items():
        size[c] += n
    out: dict[str, float] = {}
    for (c, t), n in near.items():
        p = size[c] / total
        nt = max(all_places[t], n)
        out[t] = max(out.get(t, -99.0), math.log((n + SMOOTHING * p) / (nt + SMOOTHING) / p) / -math.log(p))
    return out


def corpus(seed: int) -> list[str]:
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("ba", "ko", "le", "mi", "tu") for b in ("ra", "sen", "tol", "vix", "wan", "zu")]
    texts = []
    for i in range(600):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 40))]
        at = rng.randrange(len(words))
        if i % 20 == 0:
            words[at:at] = ["token", "=", '"' + hashlib.sha1(str((seed, i)).encode()).hexdigest() + '"']
        if i % 20 == 1:
            words[at:at] = ["Zorblatt", f"user{i}@mail.example"]
        if i % 50 == 2:
            words[at:at] = ["call", f"+1 (555) 010-{i:04d}", "now"]
        texts.append(" ".join(words))
    return texts + [texts[0]] * 30 + ["Zorblatt alone", "", None]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("limit", [True, False])
def test_degrees_equal_brute_force(spark, monkeypatch, limit):
    """With and without broadcasts."""
    monkeypatch.setattr(shared, "small", lambda df, _=None: limit)
    texts = corpus(1)
    different = list(dict.fromkeys(t or "" for t in texts))
    rows = frame(spark, different).withColumn("copy", F.xxhash64("text"))
    base = rows.select("doc_id", "copy", pii.base_spans(F.col("text")).alias("spans"))
    expected = brute_degrees(texts)
    wanted = {t: d for t, d in expected.items() if d >= 0.5}
    found = {r.term: r.degree for r in pii.disclosing_terms(rows, base, pii.CONCEPTS, REACH, SMOOTHING, 0.5, 0.97).collect()}
    assert found.keys() == wanted.keys() and len(found) >= 3 and all(math.isclose(found[t], wanted[t], rel_tol=1e-9) for t in found)
    taken = {t for t, d in expected.items() if d >= 0.8}
    got = pii.find(frame(spark, texts), generalise_at=0.8).collect()
    for r in got:
        text = texts[r.doc_id] or ""
        base_spans = brute_spans(text)
        places = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text) if term_of(m.group().lower()) in taken]
        assert [(m.s, m.e) for m in r.terms] == [(s, e) for s, e in places if not any(a < e and s < b for a, _, b, _ in base_spans)]


def test_secrets_beside_a_cue_are_taken_and_clean_texts_left_alone(spark):
    texts = corpus(2)
    docs = frame(spark, texts)
    found = pii.find(docs)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, found).collect()}
    held = {i for i, t in enumerate(texts) if t and re.search("[0-9a-f]{40}", t)}
    assert {r.doc_id for r in found.collect() if r.terms} >= held and len(held) == 60
    assert not any(re.search("[0-9a-f]{40}", clean[i]) for i in held)
    touched = {r.doc_id for r in found.collect() if r.terms or r.base}
    assert all(clean[i] == t for i, t in enumerate(texts) if i not in touched) and len(touched) < 120
    assert "Zorblatt" not in clean[len(texts) - 3] and clean[len(texts) - 1] is None


def test_repeated_rows_and_ids_with_several_texts(spark):
    texts = corpus(3)
    rows = list(enumerate(texts)) + [(0, texts[0]), (0, texts[0]), (0, "plain text"), (1, texts[20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(docs)
    own = {(r.doc_id, r.copy): [(m.s, m.e) for m in r.terms] for r in found.collect()}
    assert found.count() == len(rows) and len(own) == len(rows) - 2
    zero = [r for r in found.where("doc_id = 0").collect()]
    assert sorted(len(r.terms) for r in zero) == [0, 1, 1, 1]
    clean = [r.text for r in pii.sanitise(docs, found).where("doc_id = 0").collect()]
    assert clean.count("plain text") == 1 and len(set(clean)) == 2 and len(clean) == 4
