"""Running values in stretches: the same as one ordered walk, wherever groups are cut."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import joins, sequence
from foliant.operators.scan import Ordered


@pytest.mark.parametrize("spread", [None, 1, 7, 0])
def test_running_values_equal_a_walk(spark, spread):
    rng = random.Random(3)
    sizes = {"a": 200, "b": 1, None: 40, "c": 3}
    rows = [(g, i, rng.choice([None, 1, -2, 5]), rng.choice([None, None, None, f"v{i}"])) for g, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, x int, v string").repartition(5)
    own = Ordered(df, ["g"], [F.desc("o")], spread).running(s=F.col("x")).last(l=F.col("v")).previous(p=F.col("v"), q=F.col("x")).running(t=F.coalesce("q", F.lit(100)))
    assert own.done().columns == ["g", "o", "x", "v", "s", "l", "p", "q", "t"]
    expected, state = {}, {}
    for g, o, x, v in sorted(rows, key=lambda r: -r[1]):
        s, last, p, q, t = state.get(g, (0, None, None, None, 0))
        s, last, t = s + (x or 0), v or last, t + (100 if q is None else q)
        expected[g, o] = (s, last, p, q, t)
        state[g] = (s, last, v, x, t)
    assert {(r.g, r.o): (r.s, r.l, r.p, r.q, r.t) for r in own.done().collect()} == expected


def test_one_large_group_is_in_many_stretches(spark):
    df = spark.range(5000).select(F.lit("all").alias("g"), F.col("id").alias("o"))
    own = Ordered(df, ["g"], ["o"], 8)
    assert own.rows.groupBy("_part").count().count() >= 7
    found = own.running(n=F.lit(1)).done()
    assert found.where("n <> o + 1").isEmpty() and found.count() == 5000


def test_operators_are_the_same_in_stretches(spark):
    rng = random.Random(9)
    items = spark.createDataFrame([(d, o, rng.choice([0, 1, 2]), rng.randrange(4), 1) for d in range(3) for o in range(120)], "doc_id long, ord int, num_id int, ilvl int, abs int")
    levels = spark.createDataFrame([(1, 0, 2, None), (1, 1, 1, 0), (1, 2, None, 1), (1, 3, 4, None)], "abs int, ilvl int, start int, restart int")
    over = spark.createDataFrame([(2, 1, 50)], "num_id int, ilvl int, start int")
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(sequence.number_items(items, levels, over)) == rows(sequence.number_items(items, levels, over, 5))
    assert rows(sequence.merge_equal_runs(items, "doc_id", "ord", ["ilvl"])) == rows(sequence.merge_equal_runs(items, "doc_id", "ord", ["ilvl"], 5))
    positions = spark.createDataFrame([(i, rng.choice(["x", "y"]), rng.randrange(100) / 4) for i in range(200)], "id long, grp string, x double")
    stops = spark.createDataFrame([(g, float(p)) for g in "xy" for p in range(0, 22, 3)], "grp string, pos double")
    assert rows(joins.asof_next(positions, stops, 7.0)) == rows(joins.asof_next(positions, stops, 7.0, 6))


def test_nothing_in_order(spark):
    df = spark.createDataFrame([], "g string, o int, k int")
    assert Ordered(df, ["g"], ["o"], 3).running(n=F.lit(1)).done().count() == 0
    assert sequence.merge_equal_runs(df, "g", "o", ["k"], 3).count() == 0


def test_walks_of_any_length_equal_a_loop(spark, monkeypatch):
    """Stretches change nothing, whether items are many or none."""
    from foliant.functions import folds

    def step(at, i):
        x = F.get("v", i)
        return F.struct((at + F.coalesce(x, F.lit(0))).alias("at"), F.when(x > 2, at * 10 + x).alias("item"))

    rng = random.Random(2)
    lists = {0: [], 1: [3], **{k: [rng.choice([None, 1, 2, 3, 4]) for _ in range(rng.randrange(30))] for k in range(2, 30)}}
    df = spark.createDataFrame(list(lists.items()), "k int, v array<int>")

    def loop(v):
        at, out = 5, []
        for x in v:
            if x is not None and x > 2:
                out.append(at * 10 + x)
            at += x or 0
        return out

    for n in (1, 4, 256):
        monkeypatch.setattr(folds, "STRETCH", n)
        found = df.select("k", folds.walk(F.size("v"), F.lit(5), ("int", "int"), step).alias("w")).collect()
        assert {r.k: r.w for r in found} == {k: loop(v) for k, v in lists.items()}
