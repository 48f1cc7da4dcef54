"""What must not grow with a table: broadcasts, rows for each character, state calls, memory of a task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from foliant.functions import characters
from foliant.operators import joins, sequence
from foliant.sources import files


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_of_page_images_join_no_requests(spark):
    requests = spark.range(40).select(F.col("id").alias("req"), F.lit("").alias("spec"), F.lit(3).alias("page_count"), F.lit("d").alias("dir"), F.lit("scan").alias("stem"))
    occupied = spark.createDataFrame([("d", "scan_p001.png")], "dir string, name string")
    named = files.name_page_images(requests, occupied, "png")
    # Requests and pages are the left side of every join, and so are never broadcast.
    assert "Join Inner" not in plan(named)
    found = {(r.req, r.pos): (r.page, r.dir, r.output) for r in named.collect()}
    assert len(found) == 120 and found[(0, 0)] == (1, "d", "scan_p001 (2).png") and found[(39, 2)] == (3, "d", "scan_p003 (40).png")


def test_script_runs_sort_and_shuffle_nothing(spark):
    texts = spark.createDataFrame([(1, "ab 中文 c"), (2, " 。x"), (3, " - "), (4, "\u2014 中"), (5, ""), (6, "\U00020000 \U0001f600a"), (7, "\ue000中\ue001a")], "doc_id int, text string")
    for mode in ("context", "both"):
        runs = sequence.script_runs(texts, mode)
        assert not any(word in plan(runs) for word in ("Window", "Sort", "Generate", "Repartition"))
        found = {}
        for r in sorted(runs.collect()):
            found.setdefault(r.doc_id, []).append((r.start, r.end, r["class"]))
        assert found[1] == [(0, 3, "latin"), (3, 6, "east_asian"), (6, 7, "latin")]
        assert found[4] == ([(0, 3, "east_asian")] if mode == "both" else [(0, 2, "latin"), (2, 3, "east_asian")])
        assert found[3] == [(0, 3, "latin")] and 5 not in found
        assert found[6] == [(0, 3, "east_asian"), (3, 4, "latin")]
        assert found[7] == ([(0, 3, "east_asian"), (3, 4, "latin")] if mode == "both" else [(0, 1, "latin"), (1, 3, "east_asian"), (3, 4, "latin")])


def test_characters_are_looked_at_in_bounded_parts():
    texts = ["x" * n for n in (5, 100_000, 170_000, 1, 600_000, 3, 300_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = [(ids.to_pylist(), len(chars), first.tolist()) for ids, chars, first in characters.characters(batch)]
    assert [i for ids, _, _ in parts for i in ids] == list(range(len(texts))) and sum(n for _, n, _ in parts) == sum(map(len, texts))
    assert all(n <= 2 * characters.AT_ONCE or len(ids) == 1 or n - max(len(texts[i]) for i in ids) <= characters.AT_ONCE for ids, n, _ in parts)
    assert characters.AT_ONCE <= 1 << 18 and len(parts) == 3


def test_tokens_travel_as_stretches_of_a_document(spark):
    texts = {1: "one two three, four", 2: "", 3: " ".join(["word."] * 25_000), 4: "a\nb c", 5: "\U0001f600" * 25 + " x"}
    tokens = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("doc_id", "posexplode(split(text, ' ')) AS (pos, tok)")
    shuffled = tokens.where("doc_id <> 3").repartition(3, "tok").unionByName(tokens.where("doc_id = 3"))
    found = {}
    for r in sorted(sequence.pack_tokens(shuffled, 10).collect()):
        found.setdefault(r.doc_id, []).append((r.line, r.first, r.last, r.used))
    for d, text in texts.items():
        toks = text.split(" ")
        assert found.get(d, []) == sequence._fill(toks, list(range(len(toks))), 10, 10)
    made = plan(sequence.pack_tokens(tokens, 10))
    # One exchange, of stretches; no document is a row of structs of tokens.
    assert "collect_list" not in made and made.count("Repartition") == 1 and "Aggregate" not in made


def test_tables_are_measured_before_they_are_broadcast(spark):
    links = lambda n: spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("next"))
    chased = joins.chase_links(links(4).select("id"), links(4))
    assert "strategy=broadcast" in plan(chased)
    # Whoever leads to nothing is dealt over the tasks, and finds nothing still.
    assert sorted(tuple(r) for r in joins.chase_links(links(4).select("id"), links(4), 3).collect()) == [("0", "0"), ("1", "0"), ("2", "0"), ("3", None)]
    large = plan(joins.chase_links(links(4).select("id"), links(2_200_000)))
    assert "strategy=merge" in large and "strategy=broadcast" not in large


def test_first_difference_sorts_bounded_parts(spark, monkeypatch):
    side = lambda step: {"frag": spark.range(600).selectExpr("id % 7 AS doc", "id % 5 AS page", "id % 3 AS line", "id AS frag", "0.0D AS x", "10.0D AS size", "'f' AS font", f"IF(id % 50 = {step}, 'other', 'same') AS text")}
    whole = joins.first_difference(side(-1), side(4), 0.05)
    assert "Repartition" not in plan(whole)
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 100)
    parts = joins.first_difference(side(-1), side(4), 0.05)
    # Both sides of the join, and the rows that are counted, are dealt to six tasks.
    assert plan(parts).count("RepartitionByExpression") == 4 and sorted(map(str, parts.collect())) == sorted(map(str, whole.collect())) != []
