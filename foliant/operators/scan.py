"""Running values along the order of a group: as windows, or spread over tasks where a group is too large for one.

Spread, the rows are sorted by group and order over all tasks. A task works out the running values of
its own stretch of a group; what comes before it is one row for each stretch, and is carried on from
stretch to stretch and added. So a single document of any size is worked on by all tasks, with the same
result as the window has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


class Ordered:
    """Rows with running values. Every step gives a new one; `done` gives the rows.

    ``order`` (names or columns such as ``F.desc("x")``) must be unique within a group. ``spread``: no
    for one task a group, or the number of stretches that all rows are cut into (0: as many as the
    session has shuffle partitions).
    """

    def __init__(self, rows: DataFrame, group: list[str], order: list[str | Column], spread: int | None = None) -> None:
        self.columns, self.spread = rows.columns, spread is not None
        self.rows, self.keys, self.order = rows, list(group), list(order)
        if self.spread:
            # The group as one value, which null groups have too.
            rows = rows.withColumn("_g", F.struct(*group))
            by = ["_g", *order]
            ranged = rows.repartitionByRange(*([spread] if spread else []), *by).sortWithinPartitions(*by).withColumn("_n", F.monotonically_increasing_id())
            # Numbers become data: a lost executor cannot change them.
            self.rows = stored(ranged.withColumn("_part", F.shiftright("_n", 33)), "stretches")
            self.keys, self.order = ["_g", "_part"], ["_n"]

    def _with(self, rows: DataFrame, names: list[str]) -> Ordered:
        new = object.__new__(Ordered)
        new.__dict__ |= self.__dict__ | {"rows": rows, "columns": [*(c for c in self.columns if c not in names), *names]}
        return new

    def _step(self, local: dict[str, Column], end: dict[str, Column], carry: dict[str, Column], put: dict[str, Column]) -> Ordered:
        """``local`` values by window; of each stretch its ``end`` values, carried on as ``carry``; ``put``: both together."""
        rows = self.rows.withColumns(local)
        if not self.spread:
            return self._with(rows, list(local))
        before = rows.groupBy("_g", "_part").agg(*(c.alias(f"_e_{n}") for n, c in end.items()))
        before = before.select("_g", "_part", *(c.alias(f"_c_{n}") for n, c in carry.items()))
        return self._with(rows.join(before, ["_g", "_part"]).withColumns(put).drop(*(f"_c_{n}" for n in local)), list(local))

    @property
    def _window(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def _earlier(self):
        return Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

    def running(self, **values: Column) -> Ordered:
        """Sums of the rows up to and with each row; null counts as 0."""
        upto = self._window.rowsBetween(Window.unboundedPreceding, 0)
        local = {n: F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in values.items()}
        end = {n: F.max_by(n, "_n") for n in values}
        carry = {n: F.coalesce(F.sum(f"_e_{n}").over(self._earlier), F.lit(0)) for n in values}
        return self._step(local, end, carry, {n: F.col(n) + F.col(f"_c_{n}") for n in values})

    def last(self, **values: Column) -> Ordered:
        """The last value that is not null, up to and with each row."""
        upto = self._window.rowsBetween(Window.unboundedPreceding, 0)
        local = {n: F.last(c, ignorenulls=True).over(upto) for n, c in values.items()}
        end = {n: F.max_by(n, "_n") for n in values}
        carry = {n: F.last(f"_e_{n}", ignorenulls=True).over(self._earlier) for n in values}
        return self._step(local, end, carry, {n: F.coalesce(n, f"_c_{n}") for n in values})

    def previous(self, **values: Column) -> Ordered:
        """The value of the row before, null for a group's first."""
        # Wrapped, so that a row without a row before it differs from one after a null.
        local = {n: F.lag(F.struct(c.alias("v"))).over(self._window) for n, c in values.items()}
        end = {n: F.max_by(F.struct(c.alias("v")), "_n") for n, c in values.items()}
        carry = {n: F.lag(f"_e_{n}").over(Window.partitionBy("_g").orderBy("_part")) for n in values}
        found = self._step(local, end, carry, {n: F.coalesce(n, f"_c_{n}") for n in values})
        return found._with(found.rows.withColumns({n: F.col(n)["v"] for n in values}), list(values))

    def done(self) -> DataFrame:
        return self.rows.select(*self.columns)
