"""Text keys: natural order, stems, sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest number of the natural order; longer digit runs count as this.
MAX_NUMBER = "18446744073709551615"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there.

    As the variable of a lambda over an array of one element it cannot be inlined by the optimiser.
    """
    return F.transform(F.array(value), use)[0]


def natural_key(name: Column) -> Column:
    """Array of (kind, text, number): chunks of text and of ASCII digits; text sorts before numbers."""
    chunks = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def chunk(c: Column) -> Column:
        digits = F.ltrim(c, F.lit("0"))
        most = F.lit(MAX_NUMBER).cast("decimal(20,0)")
        number = F.when(F.length(digits) > 20, most).otherwise(F.least(F.when(digits == "", F.lit("0")).otherwise(digits).try_cast("decimal(20,0)"), most))
        is_number = c.rlike("^[0-9]")
        return F.struct(is_number.cast("int").alias("kind"), F.when(is_number, "").otherwise(F.lower(c)).alias("text"), F.when(is_number, number).otherwise(F.lit(0)).cast("decimal(20,0)").alias("num"))

    return F.transform(chunks, chunk)


def human_size(n: Column) -> Column:
    """Bytes exactly, larger units with one decimal, steps of 1024."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < mb, F.format_string("%.1f KB", n / kb))
        .when(n < gb, F.format_string("%.1f MB", n / mb))
        .otherwise(F.format_string("%.1f GB", n / gb))
    )


def comparison_text(text: Column) -> Column:
    """Without white space and control characters."""
    return F.regexp_replace(text, r"[\s\x00-\x1F\x7F]+", "")
