"""Texts of Arrow batches as arrays of code points, a bounded number of characters at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points, and characters that are looked at together. Some ten arrays of so many numbers are held at once.
CODE_POINTS, AT_ONCE = 0x110000, 1 << 18


def characters(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids (first column) of neighbouring texts (second column, none empty), their code points, and where each text begins.

    The texts of a part have about ``AT_ONCE`` characters in all, or are one longer text.
    """
    sizes = pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // AT_ONCE
    for rows in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(group)) + 1):
        if len(rows):
            part = batch.slice(int(rows[0]), len(rows))
            chars = np.frombuffer("".join(part.column(1).to_pylist()).encode("utf-32-le"), "<u4")
            yield part.column(0), chars, np.cumsum(sizes[rows]) - sizes[rows]


def stretches(ids: pa.Array, first: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Where runs begin among all characters, and their columns id, start and end within the texts."""
    start = np.flatnonzero(begins)
    doc = np.searchsorted(first, start, side="right") - 1
    end = np.append(start[1:], len(begins))
    return start, [ids.take(pa.array(doc)), *(pa.array((x - first[doc]).astype(np.int32)) for x in (start, end))]
