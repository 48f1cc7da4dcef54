"""Byte-level BPE through a deterministic automaton over tokens, and decoding.

The merges are compiled once. The automaton begins with one state and an arc for every byte. A merge
of u and v adds one gadget: wherever an arc u and then an arc v could be taken, an arc uv leads to
where v led; and the arcs u lead from now on to a copy of their target that lacks v (and, where u is
v, lacks uv). What can be read in the end are exactly the token sequences that the merges make, so a
word has one path, and so has each of its beginnings.

A state is kept as what it lacks. Tokens are numbered along the tree of their left parts, later ones
first; what one gadget takes away (v, and what later merges begin with v) is then an interval of
numbers, and a state is a sorted row of such intervals. A transition is one bisection in a row.

A word is read from left to right. The vocabulary's occurrences come from a trie of the arcs' labels;
at each place the one arc is taken that the table allows, and the arcs that lead to the word's end are
its tokens. No merge is replayed. Decoding puts the labels of the arcs one after another.

Encoding is per document and needs no shuffle. What stands between two spaces repeats, so a memo
bounded in bytes keeps its tokens for the time of a task.
"""

from __future__ import annotations

import json
import re
import struct
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import batched

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bytes of each of the two generations of the memo, and about what an entry takes besides its word and ids.
MEMO_BYTES, _ENTRY = 32 << 20, 150
#: Stretches of a text that are looked up at once.
STEP = 1 << 18

#: How texts are split before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers assigned after Unicode 16.0, which the vocabulary's library does not count as such.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_SPLIT, _LATER = regex.compile(SPLIT), re.compile(f"[{LATER}]")
#: Stretches of whole words: a new one begins at every single space between other characters, where a word always ends.
_STRETCH = re.compile(r"\s?\S+(?:\s\s+\S+)*(?:\s+\Z)?|\s+\S*(?:\s\s+\S+)*(?:\s+\Z)?")
#: Stands for them while a text is split: no letter, number or space.
_OTHER = "\U0010ffff"


def byte_letters() -> dict[str, int]:
    """The letter of each byte in vocabulary files: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """States, labels and trie of one vocabulary. Built once per Python worker from the file's bytes."""

    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or odd or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only byte-level BPE without prefix space, normalisation, dropout or fallbacks is supported")
        letters, vocab = byte_letters(), model["vocab"]
        added = {a["content"]: a["id"] for a in spec.get("added_tokens") or []}
        if any(a.get(k) for a in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens must stand for their text alone")
        self.label = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        if len({w for *_, w in merges}) < len(merges):
            raise ValueError("a token is made by two merges")
        #: Added tokens are found before anything else, the longest first.
        self.added, self.added_at = added, re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.compile(merges, [vocab[c] for c in letters])
        self.forget()

    def compile(self, merges: list[tuple[int, int, int]], single: list[int]) -> None:
        """One gadget after another; then the rows of the states that are left, and the trie."""
        born = {w: at for at, (_, _, w) in enumerate(merges)}
        first: dict[int, list[int]] = {}  # what begins with a token, later merges first
        for u, _, w in reversed(merges):
            first.setdefault(u, []).append(w)
        number, size, todo = {}, {}, [(t, False) for t in reversed(single)]
        while todo:
            token, done = todo.pop()
            if done:
                size[token] = len(number) - number[token]
                continue
            number[token] = len(number)
            todo.append((token, True))
            todo += [(t, False) for t in reversed(first.get(token, ()))]

        def taken(v: int, at: int) -> tuple[int, int]:
            """Numbers of v and of what merges from ``at`` on begin with it."""
            later = first.get(v, ())
            low, high = 0, len(later)
            while low < high:
                middle = (low + high) // 2
                low, high = (middle + 1, high) if born[later[middle]] >= at else (low, middle)
            return number[v], (number[later[low - 1]] + size[later[low - 1]]) if low else number[v] + 1

        #: A state: the one it is a copy of, and the interval that it lacks besides.
        states: list[tuple[int, int, int]] = [(-1, 0, 0)]

        def lacks(state: int, n: int) -> bool:
            while state > 0:
                state, low, high = states[state]
                if low <= n < high:
                    return True
            return False

        target, dead = dict.fromkeys(single, 0), set()
        for at, (u, v, w) in enumerate(merges):
            if u in dead or v in dead or u not in target or v not in target or lacks(target[u], number[v]):
                dead.add(w)  # u and v never meet, so no arc is added
                continue
            target[w] = target[v]
            states.append((target[u], *taken(v, at)))
            target[u] = len(states) - 1
        rows: dict[int, array] = {}
        for state in set(target.values()):
            own, at = [], state
            while at > 0:
                at, low, high = states[at]
                own.append((low, high))
            flat = array("i")
            for low, high in sorted(own):
                if flat and low <= flat[-1]:
                    flat[-1] = max(flat[-1], high)
                else:
                    flat.extend((low, high))
            rows[state] = flat
        self.start = rows.get(0, array("i"))
        self.trie = ahocorasick.Automaton()
        for token, state in target.items():
            label = self.label[token].decode("latin-1")
            self.trie.add_word(label, (token, len(label), number[token], rows[state]))
        self.trie.make_automaton()
        self.gadgets, self.states = len(states) - 1, len(rows)

    def forget(self) -> None:
        """Give back what was remembered of the words met so far."""
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def word(self, text: str) -> bytes:
        """Tokens of one word, as 32-bit numbers."""
        data = text if text.isascii() else text.encode().decode("latin-1")
        # The arc that ends at a character, and the row after it; before the first character stands the start.
        arcs: list = [None] * len(data)
        rows = [self.start] * (len(data) + 1)
        for end, arc in self.trie.iter(data):
            if arcs[end] is None:
                _, size, number, after = arc
                if not bisect_right(rows[end - size], number) & 1:
                    arcs[end], rows[end] = arc, after
        out, at = [], len(data) - 1
        while at >= 0:
            token, size, _, _ = arcs[at]
            out.append(token)
            at -= size
        return struct.pack(f"<{len(out)}I", *reversed(out))

    def words(self, text: str) -> bytes:
        """Tokens of a stretch, word by word."""
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self.word(text)  # one word
        shown = text if text.isascii() else _LATER.sub(_OTHER, text)
        word, out = self.word, bytearray()
        for m in _SPLIT.finditer(shown):
            out += word(text[m.start() : m.end()])
        return bytes(out)

    def look(self, parts: list[str] | tuple[str, ...]) -> bytes:
        """Tokens of stretches. One whose entry alone fills much of the memo is not remembered."""
        memo, large = self.memo, {}
        for part in set(parts).difference(memo):
            if (ids := self.older.get(part)) is None:
                ids = self.words(part)
            size = _ENTRY + 2 * len(part) + len(ids)
            if size > MEMO_BYTES // 64:
                large[part] = ids
            else:
                memo[part] = ids
                self.held += size
        out = b"".join([large[p] if p in large else memo[p] for p in parts] if large else map(memo.__getitem__, parts))
        if self.held >= MEMO_BYTES:
            self.memo, self.older, self.held = {}, memo if self.held < 2 * MEMO_BYTES else {}, 0
        return out

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens; a long one some stretches at a time."""
        if len(text) <= STEP:
            return self.look(_STRETCH.findall(text))
        return b"".join(self.look(parts) for parts in batched((m.group() for m in _STRETCH.finditer(text)), STEP))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if self.added_at is None or not (found := list(self.added_at.finditer(text))):
            return self.plain(text)
        out, at = [], 0
        for m in found:
            out += [self.plain(text[at : m.start()]), np.array([self.added[m.group()]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: list[int]) -> str:
        """Labels one after another; bytes that are no text become U+FFFD, unknown ids nothing."""
        label = self.label
        try:
            data = b"".join(map(label.__getitem__, ids))
        except KeyError:
            data = b"".join(label.get(i, b"") for i in ids)
        return data.decode("utf-8", "replace")


_AUTOMATA: dict[int, MergeAutomaton] = {}


def automaton(data: bytes) -> MergeAutomaton:
    key = hash(data)
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = MergeAutomaton(data)
    return _AUTOMATA[key]


def file_bytes(path: str | None = None) -> bytes:
    """The vocabulary file; without a path, that of the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens long, ids binary, decoded string: each whole text encoded, and its ids decoded again.

    ``ids`` are little-endian unsigned 32-bit numbers, the form in which token streams are stored. Null
    and empty texts give no ids and an empty decoded text. Very long texts are encoded some
    stretches at a time, so beyond the text itself memory follows its ids. An added token's text is that
    token wherever it stands. There are no ties: a word has one path. Repeated rows give repeated
    results; an empty table gives none. Rows without an id are left out and further columns are ignored.
    The vocabulary file (1.6 MB) travels with the tasks and is compiled once per worker.
    """
    data = file_bytes(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(data)
        own.forget()  # a task that was stopped may have left its words
        for batch in batches:
            for at, texts in shared.texts_of(batch, 1):
                ids = [own.encode(t) for t in texts]
                decoded = pa.array([own.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string())
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), counts, pa.array(ids, pa.binary()), decoded], ["doc_id", "n_tokens", "ids", "decoded"])
        own.forget()  # the worker may serve other tasks next

    return shared.id_text(docs).mapInArrow(shared.tidy(run), "doc_id long, n_tokens long, ids binary, decoded string")


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text: the text of a column ``ids``, binary as `encode` makes it or an array of integers.

    Null ids count as none, ids that the vocabulary lacks as no text, and bytes that are no text become
    U+FFFD. Repeated rows give repeated results; an empty table gives none; further columns are ignored.
    """
    data = file_bytes(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(data)
        for batch in batches:
            rows = [np.frombuffer(x, "<u4").tolist() if isinstance(x, bytes) else x or [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x) for x in rows], pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(shared.tidy(run), "doc_id long, text string")


def op11_merge_automaton(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    coded = encode(shared.table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
