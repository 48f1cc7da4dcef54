"""Language-model scores by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of the bigram (count of the pair over
count of its context), of the unigram, and a uniform share for each known type and one unknown. The
weights depend on the frequency of the context, in octaves. They are learned by expectation-
maximisation on held-out counts: each occurrence of a training pair is held out in turn, so it meets
estimates from which it is deleted.

Counts come from all training documents, exact for unigrams, by blocks (see ``blocks``); pairs are
identified by 56-bit hashes. Expectation-maximisation needs only the number of held-out pairs for
each combination of (pair count, context count, word count), the latter two rounded to an eighth of
an octave (4 % at most). As each class of contexts has its own weights, each is learned in a task of
its own from such a table of bounded size; only three weights a class reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import shared
from .labelled import fold
from .textwords import Words, mix

END = mix(np.array([0x5E7], np.uint64))[0]
OCTAVES, STEPS = 40, 8
_KEEP = ~np.uint64(0xFF)


def _round(count: np.ndarray) -> np.ndarray:
    """0 for none, else 1 + eighths of an octave."""
    with np.errstate(divide="ignore"):
        return np.where(count > 0, 1 + np.rint(STEPS * np.log2(np.maximum(count, 1))), 0).astype(np.uint16)


def _value(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 2.0 ** ((code.astype(float) - 1) / STEPS), 0.0)


def _octave(count: np.ndarray) -> np.ndarray:
    """Class of a context: 0 if it was not seen, else 1 + whole octaves of its count."""
    return np.where(count > 0, np.minimum(1 + np.floor(np.log2(np.maximum(count, 1)) + 1e-9), OCTAVES - 1), 0).astype(np.int64)


class Tokens:
    """Tokens of a block: the words of each text, then one end."""

    def __init__(self, texts: list[str]) -> None:
        w = Words(texts, lower=True)
        self.count = w.count + 1
        first = np.cumsum(self.count) - self.count
        self.hash = np.full(int(self.count.sum()), END, np.uint64)
        self.hash[np.arange(len(w.hash)) + w.doc] = w.hash
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        before = np.roll(self.hash, 1)
        before[first] = END  # a text begins after an end
        self.pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + self.hash) & _KEEP
        self.keys, self.key = np.unique(self.hash, return_inverse=True)
        #: Place of the context's key.
        self.context = np.roll(self.key, 1)
        self.context[first] = np.searchsorted(self.keys, END)


def _context(code: np.ndarray) -> np.ndarray:
    """Count of a context without the occurrence that is held out, from its code."""
    return np.maximum(np.rint(_value(code)) - 1, 0)


def start_weights() -> np.ndarray:
    """Weights (pair, word, uniform) of each class of contexts before learning; unseen contexts have no pairs."""
    weights = np.tile([0.3, 0.5, 0.2], (OCTAVES, 1))
    weights[0] = [0, 0.7, 0.3]
    return weights


def expectation_maximisation(cells: pd.DataFrame, total: float, types: float, rounds: int = 100) -> np.ndarray:
    """Weights (pair, word, uniform) of one class of contexts from its held-out table.

    ``cells``: pair (count), context and word (rounded codes), n. Every outcome keeps a share.
    """
    n = cells["n"].to_numpy(float)
    context = _context(cells["context"].to_numpy())
    word = np.maximum(_value(cells["word"].to_numpy()) - 1, 0)
    pair = np.minimum(cells["pair"].to_numpy(float) - 1, context)
    p = np.stack([np.where(context > 0, pair / np.maximum(context, 1), 0), word / max(total - 1, 1), np.full(len(n), 1 / (types + 1))], 1)
    seen = bool((context > 0).any())
    start = start_weights()[int(_octave(context[:1])[0])]
    weights = start
    for _ in range(rounds):
        share = weights * p
        share /= share.sum(1, keepdims=True)
        mass = n @ share + 1e-3 * weights
        new = mass / mass.sum()
        done = np.abs(new - weights).max() < 1e-7
        weights = new
        if done:
            break
    weights = np.maximum(weights, 1e-9)
    if not seen:
        weights[0] = 0
    return weights / weights.sum()


def log_scores(docs: DataFrame, training) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    ``training`` is a boolean column: the documents to learn from. Null and empty texts consist of
    the end alone. Repeated rows count and are scored repeatedly; without training documents all
    probability is uniform over the one unknown type. An empty table gives an empty result; further
    columns and rows without an id are ignored. A very long text is a block of its own, whose task
    takes about thirty times its size.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(training, F.lit(False)).alias("mark"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    word_buckets, pair_buckets = B.buckets(rows, 0.03), B.buckets(rows, 0.14)
    blocks = B.pack(rows)

    def ask_words(_: int, own: B.Documents) -> tuple[np.ndarray, list[np.ndarray]]:
        t = Tokens(own.texts)
        return t.keys, [np.bincount(t.key, own.marks[t.doc], minlength=len(t.keys)).astype(np.uint32)]

    def total(keys: np.ndarray, at: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        return np.bincount(at, columns[0], minlength=len(keys)).astype(np.uint64)

    def sizes(keys: np.ndarray, at: np.ndarray, columns: list[np.ndarray], values: np.ndarray) -> bytes:
        return f"{int(values.sum())},{int((values > 0).sum())}".encode()

    words = B.answers(B.ask(blocks, 1, ask_words, word_buckets), 1, total, [np.uint32], sizes)
    number = lambda i: F.sum(F.split(F.col("data").cast("string"), ",")[i].cast("long"))
    found = words.where("block = -1").agg(number(0).alias("total"), number(1).alias("types")).first()
    n_total, n_types = int(found.total or 0), int(found.types or 0)

    def ask_pairs(block: int, own: B.Documents, answer: pd.DataFrame) -> pd.DataFrame:
        t = Tokens(own.texts)
        counts = B.received(answer, 1, np.uint64, len(t.keys))
        keys, first, at = np.unique(t.pair, return_index=True, return_inverse=True)
        seen = np.bincount(at, own.marks[t.doc], minlength=len(keys)).astype(np.uint32)
        return B.frame(list(B.packets(block, keys, [seen, _round(counts[t.context[first]]), _round(counts[t.key[first]])], pair_buckets)), 3)

    def held_out(keys: np.ndarray, at: np.ndarray, columns: list[np.ndarray], values: np.ndarray) -> bytes:
        first = np.zeros(len(keys), np.int64)
        first[at] = np.arange(len(at))
        seen = values > 0
        capped = np.minimum(values[seen], (1 << 40) - 1).astype(np.int64)
        cell = np.stack([capped, columns[1][first][seen].astype(np.int64), columns[2][first][seen].astype(np.int64)], 1)
        # Large pair counts are rounded too, so that the table stays bounded.
        cell[:, 0] = np.where(cell[:, 0] > 64, np.rint(_value(_round(cell[:, 0]))), cell[:, 0])
        frame = pd.DataFrame({"pair": cell[:, 0], "context": cell[:, 1], "word": cell[:, 2], "n": capped}).groupby(["pair", "context", "word"], as_index=False)["n"].sum()
        return B.squeeze(np.ascontiguousarray(frame.to_numpy(np.int64)).ravel())

    pairs = B.answers(B.meet(blocks, words, ask_pairs, B.packet_type(3)), 2, total, [np.uint32, np.uint16, np.uint16], held_out)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["data"]:
                raw = B.zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 30)
                table = np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(np.int64).reshape(-1, 4)
                yield pd.DataFrame(table, columns=["pair", "context", "word", "n"])

    # Contexts of one class share their weights and no others: each class is learned by itself, from a
    # table whose size the codes bound.
    held = pairs.where("block = -1").select("data").mapInPandas(cells, "pair long, context long, word long, n long")
    summed = held.groupBy("pair", "context", "word").agg(F.sum("n").alias("n"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        weights = expectation_maximisation(pdf, n_total, n_types)
        return pd.DataFrame([[int(pdf["class"].iloc[0]), *weights]], columns=["class", "pair", "word", "uniform"]).astype({"class": "int32"})

    table = pd.DataFrame(columns=["class", "pair", "word", "uniform"])
    if n_total:
        codes = held.sparkSession.createDataFrame([(c, int(_octave(_context(np.array([c])))[0])) for c in range(STEPS * OCTAVES + 2)], "context long, class int")
        table = summed.join(F.broadcast(codes), "context").groupBy("class").applyInPandas(learn, "class int, pair double, word double, uniform double").toPandas()
    weights = start_weights()
    weights[table["class"].to_numpy(np.int64)] = table[["pair", "word", "uniform"]].to_numpy(float)

    def finish(block: int, own: B.Documents, answer: pd.DataFrame) -> pd.DataFrame:
        t = Tokens(own.texts)
        counts = B.received(answer, 1, np.uint64, len(t.keys)).astype(float)
        keys, at = np.unique(t.pair, return_inverse=True)
        pair = B.received(answer, 2, np.uint64, len(keys)).astype(float)[at]
        word, context = counts[t.key], counts[t.context]
        w = weights[_octave(context)]
        p = w[:, 0] * np.where(context > 0, np.minimum(pair / np.maximum(context, 1), 1), 0) + w[:, 1] * word / max(n_total, 1) + w[:, 2] / (n_types + 1)
        base = np.log10((word + 0.5) / (n_total + 0.5 * (n_types + 1)))
        add = lambda v: np.bincount(t.doc, v, minlength=len(own.texts))
        return pd.DataFrame({"doc_id": own.ids, "n_tokens": t.count.astype(np.int64), "n_known": add(word > 0).astype(np.int64), "train_tokens": np.int64(n_total), "base_score": add(base), "score": add(np.log10(p))})

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return B.meet(blocks, words.where("block >= 0").unionByName(pairs.where("block >= 0")), finish, schema)


def op7_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, token counts, base_score and score of every document."""
    found = log_scores(shared.table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
    return found.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
