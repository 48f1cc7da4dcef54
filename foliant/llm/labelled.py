"""Bounded samples of labelled documents and score calibration, shared by the trained classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def fold(column: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string")) % parts


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_chars: int) -> DataFrame:
    """place, text, label of at most ``max_rows`` labelled documents, up to ``max_chars`` characters together.

    ``labels``: doc_id, label. Documents come in the order of a hash of their id (``place``) until the
    budget of characters is spent; the document that crosses it is the last. Null labels are left out; an id that
    is labelled repeatedly counts once with its largest label, a repeated document once.
    """
    clean = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = clean.orderBy(*order).limit(max_rows)  # at most max_rows small rows, so safe to broadcast
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sizes = found.select("doc_id", F.length("text").alias("n")).orderBy(*order).collect()
    keep, used = [], 0
    for row in sizes:
        if used >= max_chars:
            break
        keep.append((row.doc_id, len(keep)))
        used += row.n
    places = docs.sparkSession.createDataFrame(keep, "doc_id long, place int")
    return found.join(F.broadcast(places), "doc_id").select("place", "text", "label")


def fitted(rows: DataFrame, fit: Callable[[list[str], np.ndarray], dict]) -> dict | None:
    """The model that ``fit(texts, labels)`` learns from a sample, in one task on an executor.

    The sample is bounded, so one task can hold it, and its texts never pass through the driver; a
    lost executor costs a retry. None if there are no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            own = pd.concat(parts).sort_values("place")
            model = fit(own["text"].tolist(), own["label"].to_numpy())
            yield pd.DataFrame({"model": [pickle.dumps(model)]})

    found = rows.coalesce(1).mapInPandas(shared.tidy(run), "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else None


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, with smoothed targets."""
    ones = int(label.sum())
    zeros = len(label) - ones
    if not ones or not zeros:
        prior = (ones + 1) / (len(label) + 2)
        return 0.0, float(np.log(prior / (1 - prior)))
    target = np.where(label > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    scale = float(np.abs(margin).mean()) or 1.0
    x = np.c_[margin / scale, np.ones(len(margin))]
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + 1e-3 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
