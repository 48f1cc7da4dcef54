"""Connected components against union-find, and what they cost."""

from __future__ import annotations

import random

import pytest

from foliant.llm import components


def plain(links):
    root = {x: x for pair in links for x in pair}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    return {x: top(x) for x in root}


def graphs():
    rng = random.Random(6)
    ids = rng.sample(range(-(1 << 40), 1 << 40), 600)
    ordered = sorted(ids)
    return {
        "none": [],
        "loops": [(5, 5), (5, 5)],
        "chain": list(zip(ordered, ordered[1:])),
        "mixed chain": list(zip(ids, ids[1:])),
        "hub": [(ordered[-1], x) for x in ids] * 2,
        "sparse": [tuple(rng.sample(ids, 2)) for _ in range(320)],
        "stars in several tasks": [(max(t), x) for t in (rng.sample(ids, 40) for _ in range(25)) for x in t],
    }


@pytest.mark.parametrize("rows", [1_000_000, 3])
def test_components_equal_union_find(spark, monkeypatch, rows):
    monkeypatch.setattr(components, "ROWS_AT_ONCE", rows)
    for name, links in graphs().items():
        df = spark.createDataFrame(links, "a long, b long").repartition(5)
        root = {x: r for x, r in plain(links).items() if any(x in pair and pair[0] != pair[1] for pair in links)}
        found = [tuple(r) for r in components.components(df).collect()]
        assert sorted(found) == sorted(root.items()), name
        assert sorted(tuple(r) for r in components.stars(df).collect()) == sorted((x, r) for x, r in root.items() if x != r), name


def test_components_of_stars_take_few_tasks(spark):
    """Every task leaves files and a record, whatever its rows: a round over many partitions is not free."""
    context, links = spark.sparkContext, graphs()["stars in several tasks"]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    df.count()
    context.setJobGroup("components", "components")
    components.components(df).count()
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    context.setLocalProperty("spark.jobGroup.id", None)
    context.setLocalProperty("spark.job.description", None)
    assert tasks <= 40
