"""Run a function per row; a failure becomes an error row and the rest goes on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def map_isolated(df: DataFrame, fn: Callable[[dict], tuple], schema: str = "output string, detail string") -> DataFrame:
    """ord, the columns of ``schema``, error: ``fn(row)`` gives a tuple of the former; an exception gives the error.

    ``df`` has ord, which restores the order. Rows are handled batch by batch as Arrow delivers them;
    a row whose result does not fit the number of columns is an error as well.
    """
    names = [f.name for f in StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    values = tuple(fn(row))
                    if len(values) != len(names):
                        raise ValueError(f"{len(values)} values for {len(names)} columns")
                    out.append((row["ord"], *values, None))
                except Exception as e:  # noqa: BLE001
                    out.append((row["ord"], *[None] * len(names), f"{type(e).__name__}: {e}"))
            # Objects keep integers beside nulls as they are.
            yield pd.DataFrame(out, columns=["ord", *names, "error"], dtype=object)

    return df.mapInPandas(run, f"ord long, {schema}, error string")
