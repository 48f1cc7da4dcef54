"""Substring dedup with repeated-phrase automata.

Recurring passages are confirmed first. Of each document's 18-word phrases a winnowing picks about
one in ten, so that every run of 35 words holds a picked one and equal runs hold the same; phrases
that occur more than once in the corpus mark candidate windows, and the corpus-wide count of each
candidate 35-word window confirms it and names the first block of documents that holds it. Confirmed
windows that follow each other and have one first block form a passage.

Each block is the shard of the passages it holds first. Its automaton (pyahocorasick) holds their
18-word pieces, one after the other, words as code points; the passages of all documents, wherever they are, are routed
to the shard of their first block and streamed through its automaton to locate every occurrence, and
each window around an occurrence is compared word by word with the shard's. Only what is found there
is removed: hashes confirm and route, but equal hashes of different windows remove nothing. A block
sends equal passages once, so a passage that all documents hold costs a shard one copy a block; a
shard that gets more than SALT_BYTES is split over tasks, each with the shard's own passages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import shared
from .textwords import Words, mix, powers

WINDOW = 35
#: Compressed bytes of passages that one task of a shard streams, about a block's text.
SALT_BYTES = 512 << 10
_GRAM = 0xD6E8FEB86659FD93
_GRAM_INVERSE = pow(_GRAM, -1, 1 << 64)
_POWERS: list[np.ndarray] = [powers(_GRAM, 1), powers(_GRAM_INVERSE, 1)]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` values, without regard to document borders."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    if len(_POWERS[0]) < len(h):
        _POWERS[:] = [powers(_GRAM, 2 * len(h)), powers(_GRAM_INVERSE, 2 * len(h))]
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _POWERS[0][: len(h)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * _POWERS[1][: len(h) - n + 1] + np.uint64(n))


def _slide(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """Extreme of each run of ``n`` values, by doubling."""
    width = 1
    out = x
    while width < n:
        step = min(width, n - width)
        out = pick(out[:-step], out[step:])
        width += step
    return out


class Block:
    """Words, picked phrases and windows of one block of texts."""

    def __init__(self, texts: list[str], window: int, phrase: int) -> None:
        self.window, self.phrase = window, phrase
        self.words = Words(texts)
        w = self.words
        self.left = w.first[w.doc] + w.count[w.doc] - np.arange(len(w.doc)) if len(w.doc) else np.zeros(0, np.int64)
        #: Places where a window, or a phrase, of one document starts.
        self.starts = self.left >= window
        short = grams(w.hash, phrase)
        long_enough = (w.count[w.doc] >= window) & (self.left >= phrase) if len(w.doc) else self.starts
        self.picked = np.zeros(0, np.int64)
        self.short = short
        if len(short) >= window - phrase + 1 and long_enough.any():
            span = window - phrase + 1
            # Phrases that cross a border count as largest, so that no window of a document picks them.
            value = np.where(long_enough[: len(short)], short, np.uint64(0xFFFFFFFFFFFFFFFF))
            least = _slide(value, span, np.minimum)
            inside = self.starts[: len(least)]
            least = np.where(inside, least, np.uint64(0))
            padded = np.r_[np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)]
            self.picked = np.flatnonzero((_slide(padded, span, np.maximum)[: len(value)] == value) & long_enough[: len(short)])

    def _keys(self) -> np.ndarray:
        """Keys of the picked phrases. Picked hashes are minima, so they are mixed anew to be spread evenly."""
        return mix(self.short[self.picked] + np.uint64(_GRAM))

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys of picked phrases, and whether each stands here more than once."""
        keys, n = np.unique(self._keys(), return_counts=True)
        return keys, (n > 1).astype(np.uint8)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Places of windows that hold a phrase of the corpus's repeated ones."""
        own = self._keys()
        keys = np.unique(own)
        at = self.picked[repeated[np.searchsorted(keys, own)].astype(bool)] if len(keys) else self.picked
        mark = np.zeros(len(self.left) + 1, np.int64)
        np.add.at(mark, np.maximum(at - (self.window - self.phrase), 0), 1)
        np.add.at(mark, at + 1, -1)
        return np.flatnonzero((np.cumsum(mark[:-1]) > 0) & self.starts)

    def long(self, places: np.ndarray) -> np.ndarray:
        """Hash of the windows at ``places``, from those of their first and last phrases."""
        if not len(places):
            return np.zeros(0, np.uint64)
        return mix(mix(self.short[places]) ^ self.short[places + self.window - self.phrase])


def _spread(places: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in one of the runs of ``width`` words that start at ``places``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + width, -1)
    return np.cumsum(edge[:-1]) > 0


def passages(block: Block, places: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each first block the runs of words (from, to) of its passages; ``first``: of each place."""
    order = np.lexsort((places, first))
    p, f = places[order], first[order]
    new = np.flatnonzero((np.diff(p, prepend=-2) != 1) | (np.diff(f, prepend=f[:1] - 1 if len(f) else f) != 0))
    last = np.r_[new[1:], len(p)] - 1
    runs: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(new.tolist(), last.tolist()):
        runs.setdefault(int(f[a]), []).append((int(p[a]), int(p[b]) + block.window))
    yield from runs.items()


def _distinct(block: Block, runs: list[tuple[int, int]]) -> tuple[list[bytes], list[int]]:
    """Texts of the different passages among ``runs``, and which of them each run is."""
    raw, start, end = block.words.raw, block.words.start, block.words.end
    texts: dict[bytes, int] = {}
    which = [texts.setdefault(b" ".join(raw[start[i] : end[i]].tobytes() for i in range(a, b)), len(texts)) for a, b in runs]
    return list(texts), which


#: Different words for which there is a code point of their own.
CODES = 0x100000


class Shard:
    """Automaton over the passages of one block."""

    def __init__(self, own: list[bytes], times: list[int], window: int, phrase: int, space: int = CODES) -> None:
        self.window, self.phrase, self.space = window, phrase, space
        self.codes: dict[bytes, int] = {}
        #: Windows of the passages: how often each stands in the block, and how many others hold it.
        self.windows: dict[str | bytes, int] = {}
        self.automaton = ahocorasick.Automaton()
        coded_own = [self.coded(text, learn=True) for text in own]
        #: With more words than code points some share one: the automaton then finds too much, and the words themselves decide.
        self.shared = len(self.codes) > space
        for text, coded, n in zip(own, coded_own, times):
            for w in self.keys(text, coded, range(len(coded) - window + 1)):
                self.windows[w] = self.windows.get(w, 0) + n
            for at in range(0, len(coded) - phrase + 1, window - phrase + 1):
                self.automaton.add_word(coded[at : at + phrase], True)
        self.automaton.make_automaton()

    def coded(self, text: bytes, learn: bool = False) -> str:
        """A code point for each word; one that no passage holds is unknown (a new line)."""
        codes = self.codes
        if learn:
            out = [codes.setdefault(w, 0x10000 + len(codes) % self.space) for w in text.split(b" ")]
        else:
            out = [codes.get(w, 10) for w in text.split(b" ")]
        return np.array(out, "<u4").tobytes().decode("utf-32-le")

    def keys(self, text: bytes, coded: str, places: Iterable[int]) -> list[str] | list[bytes]:
        """What tells the windows at some places apart: their codes, or their words where words share codes."""
        window = self.window
        if not self.shared:
            return [coded[at : at + window] for at in places]
        words = text.split(b" ")
        return [b" ".join(words[at : at + window]) for at in places]

    def found(self, text: bytes) -> tuple[list[int], list[str] | list[bytes]]:
        """Places of the shard's windows in a passage, and these windows."""
        if not self.windows:
            return [], []
        coded = self.coded(text)
        found = np.fromiter((end for end, _ in self.automaton.iter(coded)), np.int64) - (self.phrase - 1)
        near = np.flatnonzero(_spread(np.maximum(found - (self.window - self.phrase), 0), self.window - self.phrase + 1, len(coded) + 1))
        near = near[near <= len(coded) - self.window].tolist()
        both = [(at, w) for at, w in zip(near, self.keys(text, coded, near)) if w in self.windows]
        return [at for at, _ in both], [w for _, w in both]

    def locate(self, text: bytes, count: bool) -> np.ndarray:
        """Places of the shard's windows in a passage; ``count`` marks them as held by another block."""
        places, windows = self.found(text)
        if count:
            for w in windows:
                self.windows[w] += 1
        return np.array(places, np.int64)

    def recurring(self, text: bytes) -> np.ndarray:
        """Places in one of the block's own passages whose windows stand anywhere else."""
        places, windows = self.found(text)
        return np.array([at for at, w in zip(places, windows) if self.windows[w] > 1], np.int64)


def _repeated(keys: np.ndarray, at: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """1 for keys of two blocks, or of one that holds them more than once."""
    return (np.bincount(at, minlength=len(keys)) + np.bincount(at, columns[0], minlength=len(keys)) > 1).astype(np.uint8)


def _first_block(keys: np.ndarray, at: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """One more than the number of the first block that holds each repeated key, 0 for the others."""
    first = np.full(len(keys), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(first, at, columns[1])
    return np.where(_repeated(keys, at, columns) > 0, first + np.uint64(1), np.uint64(0))


def _pack(texts: list[bytes]) -> bytes:
    return B.zstandard.ZstdCompressor(level=1).compress(b"\n".join(texts))


def _unpack(data: bytes) -> list[bytes]:
    return B.zstandard.ZstdDecompressor().decompressobj().decompress(data).split(b"\n")


def remove_recurring(docs: DataFrame, window: int = WINDOW, salt_bytes: int = SALT_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept: every whole text without words of recurring windows.

    A window of ``window`` consecutive words recurs if its word sequence also starts anywhere else,
    in the same document or another. ``kept`` joins the other words by one space. Null and empty
    texts have no words, texts shorter than a window keep all. Repeated rows recur like any copies.
    An empty table gives an empty result; further columns are ignored. A very long text is a block of
    its own, whose task takes about thirty times its size.
    """
    phrase = window // 2 + 1
    rows = shared.id_text(docs).withColumn("mark", F.lit(False))
    first_buckets, second_buckets = B.buckets(rows, 0.02), B.buckets(rows, 0.05)
    blocks = B.pack(rows)

    def ask_phrases(_: int, own: B.Documents) -> tuple[np.ndarray, list[np.ndarray]]:
        keys, twice = Block(own.texts, window, phrase).phrases()
        return keys, [twice]

    phrases = B.answers(B.ask(blocks, 1, ask_phrases, first_buckets), 1, _repeated, [np.uint8])

    def ask_windows(block: int, own: B.Documents, answer: pd.DataFrame) -> pd.DataFrame:
        held = Block(own.texts, window, phrase)
        places = held.candidates(B.received(answer, 1, np.uint8, len(held.picked)))
        keys, n = np.unique(held.long(places), return_counts=True)
        return B.frame(list(B.packets(block, keys, [(n > 1).astype(np.uint8), np.full(len(keys), block, np.uint64)], second_buckets)), 2)

    windows = B.answers(B.meet(blocks, phrases, ask_windows, B.packet_type(2)), 2, _first_block, [np.uint8, np.uint64])
    known = phrases.unionByName(windows)

    def own_passages(held: Block, answer: pd.DataFrame) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        places = held.candidates(B.received(answer, 1, np.uint8, len(held.picked)))
        keys, at = np.unique(held.long(places), return_inverse=True)
        first = B.received(answer, 2, np.uint64, len(keys))[at] if len(keys) else np.zeros(0, np.uint64)
        yield from passages(held, places[first > 0], first[first > 0].astype(np.int64) - 1)

    def route(block: int, own: B.Documents, answer: pd.DataFrame) -> pd.DataFrame:
        held, out = Block(own.texts, window, phrase), []
        for shard, runs in own_passages(held, answer):
            texts, which = _distinct(held, runs)
            times = B.squeeze(np.bincount(which, minlength=len(texts)).astype(np.int64))
            out.append((shard, block, len(texts), _pack(texts), times))
        return pd.DataFrame(out, columns=["shard", "block", "n", "texts", "times"]).astype({"shard": "int64", "block": "int64", "n": "int32"})

    def locate(pdf: pd.DataFrame) -> pd.DataFrame:
        """Coverage of the words of every passage sent to a shard, one after the other."""
        number = int(pdf["shard"].iloc[0])
        own = pdf[pdf["block"] == number]
        texts, times = [], []
        for data, n, t in zip(own["texts"], own["n"], own["times"]):
            texts += _unpack(data)
            times += B.expand(t, np.int64, n).tolist()
        shard, out = Shard(texts, times, window, phrase), []

        def covered(text: bytes, places: np.ndarray) -> np.ndarray:
            return _spread(places, window, text.count(b" ") + 1).astype(np.uint8)

        for block, data in zip(pdf["block"], pdf["texts"]):
            if block != number:
                # A window counts once for a block, however many of its passages hold it.
                flags = [covered(t, shard.locate(t, True)) for t in _unpack(data)]
                out.append((block, 3, number, B.squeeze(np.concatenate(flags))))
        if texts:
            out.append((number, 3, number, B.squeeze(np.concatenate([covered(t, shard.recurring(t)) for t in texts]))))
        return pd.DataFrame(out, columns=["block", "kind", "bucket", "data"]).astype({"block": "int64", "kind": "int32", "bucket": "long"})

    routed = shared.stored(B.meet(blocks, known, route, "shard long, block long, n int, texts binary, times binary"), "passages")
    # One row for each shard that is split, at most one a block.
    load = routed.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("texts")) / salt_bytes).cast("int").alias("salts")).where("salts > 1")
    routed = routed.join(shared.bounded(shared.materialise(load)), "shard", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salt = F.when(F.col("shard") == F.col("block"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("block"), F.col("salts")).cast("int")))
    routed = routed.withColumn("salt", F.explode(salt)).drop("salts")
    found = shared.stored(routed.groupBy("shard", "salt").applyInPandas(locate, "block long, kind int, bucket long, data binary"), "located")

    def finish(block: int, own: B.Documents, answer: pd.DataFrame) -> pd.DataFrame:
        held = Block(own.texts, window, phrase)
        located = answer[answer["kind"] == 3] if len(answer) else answer
        gone = np.zeros(len(held.left), bool)
        for shard, runs in own_passages(held, answer):
            texts, which = _distinct(held, runs)
            sizes = [t.count(b" ") + 1 for t in texts]
            flags = np.zeros(sum(sizes), bool)
            for data in located["data"][located["bucket"] == shard]:  # a block's own come from every salt
                flags |= B.expand(data, np.uint8, len(flags)).astype(bool)
            starts = np.cumsum(sizes) - sizes
            for (a, b), w in zip(runs, which):
                gone[a:b] |= flags[starts[w] : starts[w] + sizes[w]]
        removed = np.bincount(held.words.doc, gone, minlength=len(own.texts)).astype(np.int64)
        kept = []
        for i, t in enumerate(own.texts):
            parts = t.encode("utf-8", "surrogatepass").split()
            if removed[i]:
                a = held.words.first[i]
                parts = [p for p, g in zip(parts, gone[a : a + held.words.count[i]].tolist()) if not g]
            kept.append(b" ".join(parts).decode("utf-8", "surrogatepass"))
        return pd.DataFrame({"doc_id": own.ids, "n_words": held.words.count.astype(np.int64), "n_removed": removed, "kept": kept})

    answers = known.withColumn("bucket", F.col("bucket").cast("long")).unionByName(found)
    return B.meet(blocks, answers, finish, "doc_id long, n_words long, n_removed long, kept string")


def op10_repeated_phrase_automata(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return remove_recurring(shared.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
