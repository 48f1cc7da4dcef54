"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams: words and word pairs, n-grams of character classes (runs of
capitals, small letters, digits, white space and single punctuation marks), and n-grams of the
"same word again" relation. Each indicator is scaled by the log ratio of its smoothed counts in the
two classes; dual coordinate descent then fits a linear hinge-loss model to the scaled vectors. A
logistic curve fitted to margins of rows left out of the fit turns a margin into a probability.

Only the fit uses a sample, bounded in rows and characters; scoring is one map over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, shared
from .textwords import Words, mix, pieces

WORD_SLOTS = 1 << 18
CLASS_SLOTS = 1 << 14
SLOTS = WORD_SLOTS + CLASS_SLOTS
#: Characters of texts whose n-grams are in memory at a time.
PIECE = 1 << 20

#: Character classes: capitals, letters (with every byte above ASCII), digits, white space; others stand for themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[48:58] = 48
_CLASS[[9, 10, 11, 12, 13, 32]] = 32


def _grams(symbol: np.ndarray, doc: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram of symbols within one text, and its text."""
    if len(symbol) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(len(symbol) - n + 1, salt, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + symbol[i : len(symbol) - n + 1 + i])
    inside = doc[: len(doc) - n + 1] == doc[n - 1 :]
    return h[inside], doc[: len(doc) - n + 1][inside]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every distinct feature of each text, sorted by text."""
    words = Words(texts)
    found: list[np.ndarray] = []

    def add(hashes: np.ndarray, doc: np.ndarray, base: int, slots: int) -> None:
        """Distinct features only: many n-grams of classes are few features."""
        found.append(np.unique(doc * SLOTS + (hashes % np.uint64(slots)).astype(np.int64) + base))

    for n in (1, 2):
        add(*_grams(words.hash, words.doc, n, n), 0, WORD_SLOTS)
    kind = _CLASS[words.raw]
    place = np.zeros(len(kind), np.int32)
    place[words.origin[1:]] = 1
    place = np.cumsum(place)
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (place[1:] != place[:-1])
    at = np.flatnonzero(new)
    run = np.minimum(np.diff(np.r_[at, len(kind)]), 3)
    letters = np.isin(kind[at], (65, 97, 48, 32))
    symbol = kind[at].astype(np.uint64) * np.uint64(4) + np.where(letters, np.minimum(run, 1), run).astype(np.uint64)
    for n in (1, 2, 3, 4):
        add(*_grams(symbol, place[at].astype(np.int64), n, 10 + n), WORD_SLOTS, CLASS_SLOTS)
    again = np.zeros(len(words.hash), np.uint64)
    if len(again):
        again[1:] = ((words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])).astype(np.uint64)
    for n in (1, 2, 3, 4, 5):
        h, doc = _grams(again, words.doc, n, 20 + n)
        add(h, doc, WORD_SLOTS, CLASS_SLOTS)
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys // SLOTS, keys % SLOTS


def _norms(doc: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    """Factor of each feature that gives its block (words, classes) of its text unit length."""
    block = doc * 2 + (slot >= WORD_SLOTS)
    return 1 / np.sqrt(np.maximum(np.bincount(block, minlength=2 * n), 1))[block]


def fit(texts: list[str], label: np.ndarray, cost: float = 1.0, rounds: int = 12, alpha: float = 1.0) -> dict:
    """Weights (slots + bias), slope and offset of the probability curve."""
    n = len(texts)
    # Piece by piece: only the distinct features of a text are kept, as 32-bit numbers.
    parts = [(a, *(x.astype(np.int32) for x in features(texts[a:b]))) for a, b in pieces(texts, PIECE)]
    doc = np.concatenate([d + np.int32(a) for a, d, _ in parts]) if parts else np.zeros(0, np.int32)
    slot = np.concatenate([s for *_, s in parts]) if parts else np.zeros(0, np.int32)
    del parts
    rest = np.arange(n) % 4 == 3  # for the probability curve
    edge = np.searchsorted(doc, np.arange(n + 1))
    del doc
    # A slot stands once in a text, so texts are counted one by one.
    counts = np.zeros((2, SLOTS))
    for i in np.flatnonzero(~rest):
        counts[int(label[i] > 0), slot[edge[i] : edge[i + 1]]] += 1
    ratio = np.log((alpha + counts) / (alpha + counts).sum(1, keepdims=True))
    r = ratio[1] - ratio[0]
    r[counts.sum(0) == 0] = 0
    value = np.empty(len(slot), np.float32)
    square = np.ones(n)
    for i in range(n):
        own = slot[edge[i] : edge[i + 1]]
        v = r[own] * _norms(np.zeros(len(own), np.int64), own, 1)
        value[edge[i] : edge[i + 1]] = v
        square[i] += v @ v
    sign = np.where(label > 0, 1.0, -1.0)
    # Classes weigh alike whatever their sizes.
    ones = max(1, int((label[~rest] > 0).sum()))
    zeros = max(1, int((label[~rest] == 0).sum()))
    top = np.where(label > 0, cost * (ones + zeros) / (2 * ones), cost * (ones + zeros) / (2 * zeros))
    w, bias, dual = np.zeros(SLOTS), 0.0, np.zeros(n)
    order, rng = np.flatnonzero(~rest), np.random.default_rng(7)
    for _ in range(rounds):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            s, v = slot[edge[i] : edge[i + 1]], value[edge[i] : edge[i + 1]]
            gradient = sign[i] * (w[s] @ v + bias) - 1
            new = min(max(dual[i] - gradient / square[i], 0.0), top[i])
            if (step := (new - dual[i]) * sign[i]) != 0:
                w[s] += step * v
                bias += step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    margin = np.array([w[slot[a:b]] @ value[a:b] for a, b in zip(edge, edge[1:])]) + bias
    curve = rest if 0 < label[rest].sum() < rest.sum() else ~rest
    slope, offset = labelled.platt(margin[curve], label[curve])
    return {"weights": (w * r).astype(np.float32), "bias": float(bias), "slope": slope, "offset": offset}


def score_texts(model: dict, texts: list[str]) -> np.ndarray:
    out = np.empty(len(texts))
    for a, b in pieces(texts, PIECE):
        doc, slot = features(texts[a:b])
        margin = np.bincount(doc, model["weights"][slot] * _norms(doc, slot, b - a), minlength=b - a) + model["bias"]
        out[a:b] = labelled.logistic(model["slope"] * margin + model["offset"])
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 2_000, max_chars: int = 8_000_000) -> dict:
    """Fit on a sample of at most ``max_rows`` labelled documents and about ``max_chars`` characters.

    ``labels``: doc_id, label (1 good, 0 bad). Without labelled rows the model scores 0.5.
    """
    model = labelled.fitted(labelled.sample(docs, labels, max_rows, max_chars), fit)
    return model or {"weights": np.zeros(SLOTS, np.float32), "bias": 0.0, "slope": 0.0, "offset": 0.0}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score: the probability of label 1 of every whole text.

    Null and empty texts have no features and get the score of the bias. Repeated rows are scored
    repeatedly, an empty table gives none, further columns are ignored. A very long text is one piece:
    memory is about fifty times its size. The model has a fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [score_texts(model, texts) for _, texts in shared.texts_of(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*values, np.zeros(0)]), pa.float64())], ["doc_id", "score"])

    return shared.id_text(docs).mapInArrow(shared.tidy(run), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """All columns of the documents whose score reaches ``threshold``; learns from ``labels``.

    A score equal to the threshold stays. Null texts count as empty; repeated rows have equal scores;
    rows without an id are judged like any other. A very long text is scored whole, piece by piece.
    """
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = shared.texts_of(batch, batch.schema.get_field_index("text"))
            keep = [score_texts(model, [t or "" for t in texts]) >= threshold for _, texts in parts]
            yield batch.filter(pa.array(np.concatenate([*keep, np.zeros(0, bool)])))

    return shared.text_batches(docs).mapInArrow(shared.tidy(run), docs.schema)


def op1_nb_support_vectors(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = shared.table(spark, sf_dir, "documents")
    labels = shared.table(spark, sf_dir, "labels").where(labelled.fold("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    return score(docs, train(docs, labels)).select(
        "doc_id", (labelled.fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )
