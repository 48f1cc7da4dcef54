"""The token automaton against the tokenizers library and against merges replayed one by one."""

from __future__ import annotations

import hashlib
import json
import random
import struct

import numpy as np
import pyarrow.parquet as pq
import pytest

from foliant.llm import merge_automaton as M
from foliant.llm import queries

from . import odd


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def own():
    return M.MergeAutomaton(M.file_bytes())


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_equal_to_the_library(library, own, sf_dir):
    rng = random.Random(11)
    tokens = [b.decode("utf-8", "replace") for b in own.label.values()]
    texts = [t or "" for t in pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()]
    texts += ["", " ", "\n", "a  b\n\n c\t", " \n x", "<|endoftext|>a<|endoftext|>", "<|endoftext", "x" * 3000, "- " * 400, "-" * 999, "don't WE'LL 'll'd"]
    texts += ["".join(rng.choice(tokens) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    texts += ["".join(rng.choice("abehtninorse ' \n\x1c\x85\xa0　é日😀\x00") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for t in texts:
        found = ids(own.encode(t))
        assert found == library.encode(t, add_special_tokens=False).ids, t[:80]
        assert own.decode(found) == library.decode(found, skip_special_tokens=False) == t


def test_every_character_is_split_as_by_the_library(library, own):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(every), 500):
        text = "".join(f"a{c}1{c}!{c} {c}" for c in every[at : at + 500])
        assert ids(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_decoding_of_any_ids(library, own):
    rng = random.Random(12)
    for _ in range(1000):
        some = [rng.randrange(50257) for _ in range(rng.randint(0, 20))]
        assert own.decode(some) == library.decode(some, skip_special_tokens=False)


def vocabulary(merges):
    letters = list(M.byte_letters())
    tokens = [*letters, *dict.fromkeys(a + b for a, b in merges)]
    return json.dumps({"model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "added_tokens": []}).encode()


def replay(word, merges):
    for a, b in merges:
        out, at = [], 0
        while at < len(word):
            if word[at : at + 2] == [a, b]:
                out.append(a + b)
                at += 2
            else:
                out.append(word[at])
                at += 1
        word = out
    return word


def test_gadgets_read_what_merging_makes():
    """Small random vocabularies, with equal halves and merges that can never apply among them."""
    rng = random.Random(13)
    for _ in range(60):
        tokens, merges = list("ab" if rng.random() < 0.5 else "abc"), []
        for _ in range(rng.randint(1, 14)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                merges.append([a, b])
                tokens.append(a + b)
        data = vocabulary(merges)
        own, number = M.MergeAutomaton(data), json.loads(data)["model"]["vocab"]
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 25)))
            assert ids(own.word(word)) == [number[t] for t in replay(list(word), merges)], (merges, word)


def test_two_ways_to_one_token_are_refused():
    with pytest.raises(ValueError, match="two merges"):
        M.MergeAutomaton(vocabulary([["a", "b"], ["b", "c"], ["ab", "c"], ["a", "bc"]]))


def test_memo_and_steps_change_nothing(own, monkeypatch):
    text = "one two  three\n\nfour's <|endoftext|> five 66 " * 300 + "é日😀" * 500
    whole = own.encode(text)
    monkeypatch.setattr(M, "MEMO_BYTES", 4000)
    monkeypatch.setattr(M, "STEP", 7)
    own.forget()
    assert own.encode(text) == whole and own.held < 8000


def test_odd_documents(spark, library):
    found = M.encode(odd.docs(spark)).collect()
    assert sorted((r.doc_id, r.decoded) for r in found) == sorted((i, t or "") for i, t, *_ in odd.ROWS if i is not None)
    assert all(ids(r.ids) == library.encode(r.decoded, add_special_tokens=False).ids and r.n_tokens == len(r.ids) // 4 for r in found)
    assert M.encode(odd.empty(spark)).count() == 0
    again = M.decode(M.encode(odd.docs(spark))).collect()
    assert sorted((r.doc_id, r.text) for r in again) == sorted((r.doc_id, r.decoded) for r in found)
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64, 50256]), (4, [70_000])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.text for r in M.decode(rows).collect()} == {1: "", 2: "", 3: "a<|endoftext|>", 4: ""}


def test_query_equals_the_library(spark, sf_dir, library):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    found = queries.QUERIES["op11_merge_automaton"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        expected = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        text = library.decode(expected, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(expected), sha(struct.pack(f"<{len(expected)}I", *expected)), sha(text.encode()))
