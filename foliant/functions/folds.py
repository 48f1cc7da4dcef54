"""Walks along arrays in which a step depends on the steps before it, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Places that are walked before their items join those of the places before.
STRETCH = 256


def walk(size: Column, start: Column, kinds: tuple[str, str], step: Callable[[Column, Column], Column]) -> Column:
    """Array of the items along the places 0 to ``size`` - 1.

    ``step`` gives, from the state and a place, a struct of the next state (at) and an item (null: none).
    ``kinds``: the types of state and item. Items are gathered a stretch at a time, so that those of a long walk are
    not copied for each further one.
    """
    at, item = kinds
    state = lambda a, items: F.struct(a.cast(at).alias("at"), items.cast(f"array<{item}>").alias("items"))

    def take(s: Column, i: Column) -> Column:
        return let(step(s["at"], i).cast(f"struct<at:{at},item:{item}>"), lambda t: state(t["at"], F.when(t["item"].isNull(), s["items"]).otherwise(F.array_append(s["items"], t["item"]))))

    def stretch(s: Column, first: Column) -> Column:
        own = F.sequence(first, F.least(first + (STRETCH - 1), size - 1))
        return let(F.aggregate(own, state(s["at"], F.array()), take), lambda t: state(t["at"], F.concat(s["items"], t["items"])))

    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(STRETCH))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(starts, state(start, F.array()), stretch, lambda s: s["items"])
