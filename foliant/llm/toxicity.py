"""Toxic spans by a linear-chain conditional random field with two states.

Labels say only which documents are toxic, so tokens are labelled first: a token of a toxic document
is toxic if its word, or the beginning of its word, is bound to toxic documents (log-likelihood
ratio of document counts, with next to no clean document). The field has features for the word and
its beginnings and end, and transition weights; it is trained by gradient steps on the conditional
likelihood. Forward-backward marginals give each token's probability; their sum, through a logistic
curve, gives the document's score, and tokens above one half give the offending offsets.

A document is one chain. It is laid out as rows of 64 tokens, so that all rows of many documents
advance together as one array: each row's product of transition and emission matrices carries the
messages from row to row, forward and backward, and the marginals are those of the whole chain.
Only training uses a sample, bounded in rows and characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, shared
from .textwords import Words, mix, pieces, range_hashes

CHAIN = 64
#: One in so many clean documents is learned from.
EIGHTH = 8
PREFIXES = (3, 4, 5, 6, 7)
#: Every ASCII byte but letters and digits parts words.
_GAP = np.ones(256, bool)
_GAP[128:] = False
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = False


class Tokens:
    """Tokens of a list of texts, their distinct words, and the features of each distinct word."""

    def __init__(self, texts: list[str]) -> None:
        self.words = Words(texts, lower=True, space=_GAP)
        self.kinds, first, self.kind = np.unique(self.words.hash, return_index=True, return_inverse=True)
        start, end = self.words.start[first], self.words.end[first]
        order = np.argsort(start)
        start, end = start[order], end[order]
        columns = [self.kinds[order]]
        for k in PREFIXES:
            columns.append(mix(range_hashes(self.words.raw, start, np.minimum(start + k, end)) + np.uint64(k)))
            columns[-1][end - start < k] = 0
        columns.append(mix(range_hashes(self.words.raw, np.maximum(end - 3, start), end) + np.uint64(99)))
        table = np.stack(columns, 1)
        self.features = np.empty_like(table)
        self.features[order] = table

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers laid out as rows of CHAIN tokens of one document, -1 where a row ends early.

        Also which rows begin a document; the rows of a document follow each other.
        """
        w = self.words
        rows = -(-w.count // CHAIN)
        base = np.cumsum(rows) - rows
        inside = np.arange(len(w.doc)) - w.first[w.doc]
        out = np.full((int(rows.sum()), CHAIN), -1)
        out[base[w.doc] + inside // CHAIN, inside % CHAIN] = np.arange(len(w.doc))
        first = np.zeros(len(out), bool)
        first[base[rows > 0]] = True
        return out, first


def _emissions(tokens: Tokens, keys: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Weight of state 1 against state 0 of each distinct word."""
    if not len(keys):
        return np.full(len(tokens.kinds), bias)
    at = np.minimum(np.searchsorted(keys, tokens.features), len(keys) - 1)
    return bias + np.where(keys[at] == tokens.features, weights[at], 0.0).sum(1)


def _normal(x: np.ndarray) -> np.ndarray:
    """Scaled to a sum of one by row: messages are known up to a factor."""
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


def _carried(product: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages that enter each row from the left and from the right."""
    rows = len(product)
    into, back = np.full((rows, 2), 0.5), np.full((rows, 2), 0.5)
    starts = np.flatnonzero(first)
    sizes = np.diff(np.r_[starts, rows])
    for k in range(1, int(sizes.max(initial=0))):
        # The k-th row of all documents that have one, and the k-th from their ends.
        own = starts[sizes > k] + k
        into[own] = _normal((into[own - 1, None, :] @ product[own - 1])[:, 0])
        end = (starts + sizes)[sizes > k] - 1 - k
        back[end] = _normal((product[end + 1] @ back[end + 1, :, None])[:, :, 0])
    return into, back


def marginals(emission: np.ndarray, chains: np.ndarray, first: np.ndarray, transition: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over whole documents. emission: per token, for state 1; transition: 2 x 2 log weights.

    ``chains`` and ``first`` as of ``Tokens.chains``. Returns each token's probability of state 1 and
    the expected number of each transition; ``weight``: how much the transitions of each row count.
    """
    rows, steps = chains.shape
    real = chains >= 0
    e = np.where(real, emission[chains] if len(emission) else 0.0, 0.0)
    t = np.exp(transition)
    u = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], 2)
    # What a step does to a message from the left; the first token of a document has no transition.
    step = lambda i: np.where(first[:, None, None] & (i == 0), np.eye(2), t) * u[:, i, None, :]
    product = np.broadcast_to(np.eye(2), (rows, 2, 2))
    for i in range(steps):
        product = np.where(real[:, i, None, None], _normal(product @ step(i)), product)
    into, back = _carried(product, first)
    forward = np.empty((steps + 1, rows, 2))
    forward[0] = f = into
    for i in range(steps):
        f = forward[i + 1] = np.where(real[:, i, None], _normal((f[:, None, :] @ step(i))[:, 0]), f)
    weight = np.ones(rows) if weight is None else weight
    expected, b = np.zeros((2, 2)), back
    p = np.empty((steps, rows))
    for i in range(steps - 1, -1, -1):
        both = forward[i + 1] * b
        p[i] = both[:, 1] / both.sum(1)
        right = b * u[:, i]
        counted = real[:, i] & ~(first & (i == 0))
        pair = _normal(forward[i][:, :, None] * t[None] * right[:, None, :])
        expected += (pair[counted] * weight[counted, None, None]).sum(0)
        b = np.where(counted[:, None], _normal(right @ t.T), b)
    out = np.zeros(len(emission))
    out[chains[real]] = p.T[real]
    return out, expected


def _seeds(tokens: Tokens, label: np.ndarray) -> np.ndarray:
    """Features whose documents are toxic far beyond chance, sorted."""
    n_kinds = len(tokens.kinds)
    pair = np.unique(tokens.words.doc * n_kinds + tokens.kind)
    doc, kind = pair // max(n_kinds, 1), pair % max(n_kinds, 1)
    tables = []
    # One kind of feature at a time, which bounds the memory.
    for column in range(tokens.features.shape[1] - 1):
        values, code = np.unique(tokens.features[:, column], return_inverse=True)
        both = np.unique(doc * len(values) + code[kind])
        d, f = both // max(len(values), 1), both % max(len(values), 1)
        size = np.bincount(f, minlength=len(values))
        toxic = np.bincount(f, label[d] > 0, minlength=len(values))
        own = values != 0
        tables.append(np.stack([values[own], size[own].astype(np.uint64), toxic[own].astype(np.uint64)]))
    table = np.concatenate(tables, 1)
    ones, n = int((label > 0).sum()), len(label)
    a, b = table[2].astype(float), (table[1] - table[2]).astype(float)
    rate = max(ones, 1) / max(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(a > 0, a * np.log(a / ((a + b) * rate)), 0) + np.where(b > 0, b * np.log(b / ((a + b) * (1 - rate))), 0))
    keep = (g >= 2 * np.log(max(len(a), 2)) + 2) & (a >= 0.97 * (a + b))
    return np.unique(table[0][keep])


def fit(texts: list[str], label: np.ndarray, rounds: int = 50, penalty: float = 0.05) -> dict:
    """Feature keys and weights, bias, transition weights, and the logistic curve of the scores."""
    tokens = Tokens(texts)
    seeds = _seeds(tokens, label)
    hit = np.isin(tokens.features[:, :-1], seeds).any(1) if len(seeds) else np.zeros(len(tokens.kinds), bool)
    y = hit[tokens.kind] & (label[tokens.words.doc] > 0)
    # Clean documents are nearly alike: the field learns from all toxic ones and from every eighth of
    # the clean, which then counts eight times, in emissions and in transitions.
    chains, first = tokens.chains()
    clean = np.cumsum(label == 0)
    importance = np.where(label > 0, 1.0, np.where(clean % EIGHTH == 1, float(EIGHTH), 0.0))
    doc_of_row = tokens.words.doc[chains[:, 0]] if len(chains) else np.zeros(0, np.int64)
    taken = importance[doc_of_row] > 0
    c, begins, weight = chains[taken], first[taken], importance[doc_of_row[taken]]
    by_token = importance[tokens.words.doc]
    used = by_token > 0
    own = np.bincount(tokens.kind[used], minlength=len(tokens.kinds)) > 0 if len(y) else np.zeros(0, bool)
    values, counts = np.unique(tokens.features[own], return_counts=True)
    keys = values[((counts >= 2) | np.isin(values, seeds)) & (values != 0)]
    weights, bias, transition = np.zeros(len(keys)), -4.0, np.zeros((2, 2))
    if len(keys) and y.any():
        at = np.minimum(np.searchsorted(keys, tokens.features), len(keys) - 1)
        at = np.where(keys[at] == tokens.features, at, len(keys))
        # Transitions of the labels: each token and the one before it in its document.
        gold = np.zeros((2, 2))
        after = np.flatnonzero(used[1:] & (tokens.words.doc[1:] == tokens.words.doc[:-1])) + 1
        np.add.at(gold, (y[after - 1].astype(int), y[after].astype(int)), by_token[after])
        mean, square = np.zeros(len(keys) + 5), np.zeros(len(keys) + 5)
        for k in range(1, rounds + 1):
            emission = bias + np.r_[weights, 0.0][at].sum(1)
            p, expected = marginals(emission[tokens.kind], c, begins, transition, weight)
            error = np.where(used, (y - p) * by_token, 0.0)
            by_kind = np.bincount(tokens.kind, error, minlength=len(tokens.kinds))
            g = np.bincount(at.ravel(), np.repeat(by_kind, at.shape[1]), minlength=len(keys) + 1)[:-1] - penalty * weights
            g = np.r_[g, by_kind.sum(), (gold - expected).ravel()]
            # Adam: steps of like size for frequent and rare features.
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            step = 0.3 * (1 - k / (rounds + 5)) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-6)
            weights, bias, transition = weights + step[:-5], bias + step[-5], transition + 0.3 * step[-4:].reshape(2, 2)
        keep = np.abs(weights) > 1e-3
        keys, weights = keys[keep], weights[keep]
    model = {"keys": keys, "weights": weights, "bias": float(bias), "transition": transition, "slope": 1.0, "offset": 0.0}
    sums = _sums(model, tokens, len(texts))[0]
    model["slope"], model["offset"] = labelled.platt(np.log(sums + 1e-3), label)
    return model


def _sums(model: dict, tokens: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    emission = _emissions(tokens, model["keys"], model["weights"], model["bias"])[tokens.kind]
    p, _ = marginals(emission, *tokens.chains(), model["transition"])
    return np.bincount(tokens.words.doc, p, minlength=n), p


def tag_texts(model: dict, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Score and offending (start, end) code points of each text."""
    scores, spans = np.empty(len(texts)), [[] for _ in texts]
    for a, b in pieces(texts):
        tokens = Tokens(texts[a:b])
        sums, p = _sums(model, tokens, b - a)
        scores[a:b] = labelled.logistic(model["slope"] * np.log(sums + 1e-3) + model["offset"])
        words = tokens.words
        for i in np.flatnonzero(p >= 0.5):
            doc = int(words.doc[i])
            origin, s, e = int(words.origin[doc]), int(words.start[i]), int(words.end[i])
            before = int((words.raw[origin:s] & 0xC0 != 0x80).sum())
            spans[a + doc].append((before, before + int((words.raw[s:e] & 0xC0 != 0x80).sum())))
    return scores, spans


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3_000, max_chars: int = 12_000_000) -> dict:
    """Fit on a sample of at most ``max_rows`` labelled documents and ``max_chars`` characters.

    ``labels``: doc_id, label (1 toxic). Without labelled rows every score is one half.
    """
    model = labelled.fitted(labelled.sample(docs, labels, max_rows, max_chars), fit)
    return model or {"keys": np.zeros(0, np.uint64), "weights": np.zeros(0), "bias": 0.0, "transition": np.zeros((2, 2)), "slope": 0.0, "offset": 0.0}


def tag(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, spans (start, end in code points): toxicity of every whole text.

    Null and empty texts have no tokens and get the score of an expected count of zero. Repeated rows
    are tagged repeatedly, an empty table gives none, further columns are ignored. A very long text is
    one chain, whose task takes about forty times its size.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in shared.texts_of(batch, 1):
                scores, spans = tag_texts(model, texts)
                rows = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(scores, pa.float64()), rows], ["doc_id", "score", "spans"])

    return shared.id_text(docs).mapInArrow(shared.tidy(run), "doc_id long, score double, spans array<struct<start:int,end:int>>")


def op9_crf_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans of every document."""
    docs = shared.table(spark, sf_dir, "documents")
    labels = shared.table(spark, sf_dir, "labels").where(labelled.fold("doc_id", 4) != 2).select("doc_id", F.col("toxic").alias("label"))
    return tag(docs, train(docs, labels)).select(
        "doc_id", (labelled.fold("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "spans"
    )
