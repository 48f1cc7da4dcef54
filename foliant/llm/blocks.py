"""Corpus statistics by blocks of documents.

Operators that need the corpus-wide count of every n-gram of every document would shuffle one row
for each token. Here documents are packed into blocks of some megabytes, kept compressed in the
shared folder. A block asks for each distinct key it holds once, sorted and delta-coded, in one
packet for each bucket of the hash space; a bucket adds up the packets of all blocks and answers
every packet in its own order, so that answers need no keys; a block meets its answers by a cogroup.
A key that all blocks hold is one entry of each block, however frequent it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bytes of text of a block (a longer document is a block of its own), and keys of a bucket.
BLOCK_BYTES, BUCKET_KEYS = 4 << 20, 1_500_000

_ANSWER = "block long, kind int, bucket int, data binary"


def squeeze(values: np.ndarray) -> bytes:
    """Compress an array of one dtype, byte planes apart."""
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.copy()
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, kind: type, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, n * np.dtype(kind).itemsize)), np.uint8)
    return planes.reshape(-1, n).T.copy().view(kind).ravel() if n else np.zeros(0, kind)


def sorted_keys(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def read_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(expand(data, np.uint64, n), dtype=np.uint64)


class Documents(NamedTuple):
    """The documents of one block."""

    ids: np.ndarray
    marks: np.ndarray
    texts: list[str]


def pack(docs: DataFrame) -> DataFrame:
    """block, n, ids, marks, sizes, texts: documents packed into stored blocks. ``docs``: doc_id, mark (boolean), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, texts, size, number, part = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            binary = [np.array(ids, np.int64), np.array(marks, np.uint8), np.array([len(t) for t in texts], np.int64)]
            own = [pa.array([(part << 24) + number]), pa.array([len(ids)], pa.int32()), *(pa.array([x.tobytes()]) for x in binary), pa.array([data])]
            return pa.RecordBatch.from_arrays(own, ["block", "n", "ids", "marks", "sizes", "texts"])

        for batch in batches:
            for p, i, m, t in zip(*(c.to_pylist() for c in batch.columns)):
                part = p
                data = t.encode("utf-8", "surrogatepass")
                if ids and size + len(data) > BLOCK_BYTES:
                    yield flush()
                    ids, marks, texts, size, number = [], [], [], 0, number + 1
                ids.append(i)
                marks.append(m)
                texts.append(data)
                size += len(data)
        if ids:
            yield flush()

    rows = docs.select(F.spark_partition_id().alias("part"), "doc_id", "mark", "text")
    return shared.stored(rows.mapInArrow(run, "block long, n int, ids binary, marks binary, sizes binary, texts binary"), "blocks")


def documents(row: pd.Series) -> Documents:
    sizes = np.frombuffer(row["sizes"], np.int64)
    raw = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, int(sizes.sum())))
    ends = np.cumsum(sizes)
    texts = [raw[e - s : e].decode("utf-8", "surrogatepass") for s, e in zip(sizes.tolist(), ends.tolist())]
    return Documents(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["marks"], np.uint8), texts)


def buckets(docs: DataFrame, keys_per_byte: float) -> int:
    """How many buckets keep each at about BUCKET_KEYS entries; ``docs``: doc_id, text."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(8, int(total * keys_per_byte / BUCKET_KEYS) + 1)


def packets(block: int, keys: np.ndarray, columns: list[np.ndarray], count: int) -> Iterator[dict]:
    """One row for each bucket of the sorted distinct ``keys``; ``columns`` travel along."""
    width = (1 << 64) // count + 1
    edges = np.searchsorted(keys, np.array([min(i * width, (1 << 64) - 1) for i in range(1, count)], np.uint64))
    for bucket, (a, b) in enumerate(zip([0, *edges.tolist()], [*edges.tolist(), len(keys)])):
        if b > a:
            yield {"bucket": bucket, "block": block, "n": b - a, "keys": sorted_keys(keys[a:b]), **{f"c{i}": squeeze(np.ascontiguousarray(c[a:b])) for i, c in enumerate(columns)}}


def packet_type(columns: int) -> str:
    return "bucket int, block long, n int, keys binary" + "".join(f", c{i} binary" for i in range(columns))


def frame(rows: list[dict], columns: int) -> pd.DataFrame:
    names = ["bucket", "block", "n", "keys", *(f"c{i}" for i in range(columns))]
    return pd.DataFrame(rows, columns=names).astype({"bucket": "int32", "block": "int64", "n": "int32"})


def ask(blocks: DataFrame, columns: int, fn: Callable[[int, Documents], tuple[np.ndarray, list[np.ndarray]]], count: int) -> DataFrame:
    """Packets of every block. ``fn(block, documents)`` gives sorted, evenly spread, distinct keys and columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                yield frame(list(packets(row["block"], *fn(row["block"], documents(row)), count)), columns)

    # Some blocks at a time, as each is some megabytes when unpacked.
    return blocks.mapInPandas(run, packet_type(columns))


def answers(found: DataFrame, kind: int, fn: Callable[[np.ndarray, list[np.ndarray], pd.DataFrame], np.ndarray], kinds: list[type], extra: Callable | None = None) -> DataFrame:
    """Answers to packets, stored. ``fn`` gets all distinct keys of a bucket, the position of every
    packet entry among them, and the packets' columns; it returns a value for each distinct key.
    ``extra`` may give further rows of the bucket (as block -1).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        parts = [read_keys(k, n) for k, n in zip(pdf["keys"], pdf["n"])]
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        columns = [np.concatenate([expand(d, kind_, n) for d, n in zip(pdf[f"c{i}"], pdf["n"])]) for i, kind_ in enumerate(kinds)]
        values = fn(keys, at, columns)
        ends = np.cumsum(pdf["n"].to_numpy())
        out = [(b, kind, k, squeeze(values[at[e - n : e]])) for b, k, n, e in zip(pdf["block"], pdf["bucket"], pdf["n"], ends)]
        if extra is not None:
            out.append((-1, kind, int(pdf["bucket"].iloc[0]), extra(keys, at, columns, values)))
        return pd.DataFrame(out, columns=["block", "kind", "bucket", "data"]).astype({"block": "int64", "kind": "int32", "bucket": "int32"})

    return shared.stored(found.groupBy("bucket").applyInPandas(run, _ANSWER), "answers")


def received(answer: pd.DataFrame, kind: int, value: type, n: int) -> np.ndarray:
    """Values of one kind for the sorted distinct keys of a block, in their order."""
    if not len(answer):  # a block without answers gets a frame without columns
        return np.zeros(0, value)
    own = answer[answer["kind"] == kind].sort_values("bucket")
    width = np.dtype(value).itemsize
    parts = []
    for data in own["data"]:
        raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, n * width))
        parts.append(np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(value).ravel())
    return np.concatenate(parts) if parts else np.zeros(0, value)


def meet(blocks: DataFrame, answer: DataFrame, fn: Callable[[int, Documents, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``fn(block, documents, answers)`` to every block and its answers."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([fn(int(row["block"]), documents(row), right) for _, row in left.iterrows()])

    return blocks.groupBy("block").cogroup(answer.where("block >= 0").groupBy("block")).applyInPandas(run, schema)
