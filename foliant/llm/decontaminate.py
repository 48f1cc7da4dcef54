"""Benchmark decontamination with a distributed positional inverted index.

Only DataFrame functions are used. The terms of the index are pairs of adjacent words; it holds the
postings (term, row, pos) of every benchmark pair, which is about one in fifteen of the corpus' words
(single words of the benchmark are every second one). A window of ten item words is looked up by its
two halves: the list of the half's rarest pair, shifted by its offset, gives candidate starts, which
are intersected with the shifted list of the next rarest. What is left is compared word by word in
the document itself. Where both halves stand one after the other the window occurs (exact match);
where one half stands and all but one of the other five words are near their places, the window is a
near miss (proximity match): a window with one word altered, added or left out always keeps a half.

Texts are split once, into a stored table of words whose rows are numbered; later steps read that. No
text or array of words is shuffled: candidates' numbers are broadcast, if their size allows, to pick
the rows to compare. Every broadcast is checked in bytes; beyond the limit the same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import bounded

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, after A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH, PROBES, SLOP = 10, 2, 2


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL), GAPS), "")


def tokens(docs: DataFrame) -> DataFrame:
    """row, doc_id, copy, n_words, w (array of words) of the rows that have an id, stored.

    ``row`` numbers the rows, ``copy`` is a hash of the text: rows may share an id.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy"), words(F.col("text")).alias("w"))
    return shared.stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "copy", F.size("w").cast("long").alias("n_words"), "w"), "words")


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, win (array of words): every run of ``width`` words; of a shorter item all its words."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return items.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(width)).alias("win")).distinct()


def _pairs(w: Column) -> Column:
    """Adjacent words (a, b) of an array of words; its only word with an empty one."""
    return F.when(F.size(w) == 1, F.array(F.struct(w[0].alias("a"), F.lit("").alias("b")))).otherwise(F.arrays_zip(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))).alias("a"), F.slice(w, 2, F.size(w)).alias("b")))


def index(tok: DataFrame, phrases: DataFrame) -> DataFrame:
    """The stored postings a, b, row, pos (from 0) of all pairs of words in ``phrases`` (a column phrase)."""
    terms = shared.materialise(phrases.select(F.explode(_pairs(F.col("phrase"))).alias("t")).select("t.*").distinct())
    zipped = F.arrays_zip(F.col("w").alias("a"), F.concat(F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), F.array(F.lit(""))).alias("b"))
    spread = tok.where("size(w) > 0").select("row", F.posexplode(zipped).alias("pos", "t")).select("row", "pos", "t.a", "t.b")
    found = spread.join(bounded(terms.where("b <> ''")), ["a", "b"])
    single = terms.where("b = ''")
    if not single.isEmpty():
        found = found.unionByName(spread.drop("b").join(bounded(single), "a"))
    return shared.stored(found.select("a", "b", "row", "pos"), "postings")


def probes(postings: DataFrame, phrases: DataFrame, count: int = PROBES) -> DataFrame:
    """phrase, rank, a, b, off: the pairs of each phrase that have the fewest postings.

    Phrases with a pair that no document has are left out: they occur nowhere.
    """
    spread = phrases.select("phrase", F.posexplode(_pairs(F.col("phrase"))).alias("off", "t")).select("phrase", "off", "t.*")
    frequency = shared.materialise(postings.groupBy("a", "b").count())
    known = spread.join(bounded(frequency), ["a", "b"], "left")
    ranked = known.groupBy("phrase").agg(F.count_if(F.col("count").isNull()).alias("missing"), F.slice(F.array_sort(F.collect_list(F.struct("count", "off", "a", "b"))), 1, count).alias("best")).where("missing = 0")
    return shared.materialise(ranked.select("phrase", F.posexplode("best").alias("rank", "p")).select("phrase", "rank", "p.a", "p.b", "p.off"))


def candidates(postings: DataFrame, probe: DataFrame, count: int = PROBES) -> DataFrame:
    """phrase, row, start where all probes of a phrase stand at their offsets."""
    at = lambda rank: bounded(probe.where(F.col("rank") == rank).drop("rank"))
    found = postings.join(at(0), ["a", "b"]).select("phrase", "row", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    for rank in range(1, count):
        # A phrase of fewer pairs has no such probe and passes.
        wanted = found.join(at(rank), "phrase", "left").withColumn("pos", F.col("start") + F.col("off"))
        having = wanted.where("a is not null").join(postings, ["a", "b", "row", "pos"], "left_semi")
        found = having.select("phrase", "row", "start").unionByName(wanted.where("a is null").select("phrase", "row", "start"))
    return found.distinct()


def _with_words(tok: DataFrame, by_row: DataFrame) -> DataFrame:
    """row, w and the columns of ``by_row``, which has one line for some of the rows."""
    tok, ids = tok.select("row", "w"), by_row.select("row")
    if shared.small(by_row):
        return tok.join(F.broadcast(by_row), "row")
    if shared.small(ids):
        # Only the rows to compare meet the candidates in an exchange.
        tok = tok.join(F.broadcast(ids), "row", "left_semi")
    return tok.join(by_row, "row")


def phrase_matches(tok: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, row, start (from 0): all exact occurrences of distinct ``phrases`` (a column phrase)."""
    postings = index(tok, phrases)
    found = candidates(postings, probes(postings, phrases))
    by_row = shared.materialise(found.groupBy("row").agg(F.collect_list(F.struct("start", "phrase")).alias("c")))
    same = lambda c: F.slice(F.col("w"), c["start"] + 1, F.size(c["phrase"])) == c["phrase"]
    return _with_words(tok, by_row).select("row", F.explode(F.filter("c", same)).alias("c")).select("c.phrase", "row", "c.start")


def contamination(tok: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = SLOP) -> DataFrame:
    """row, n_hit, items, near: one line for each row of ``tok`` with an exact or near window.

    ``n_hit``: words inside any occurrence of a window. ``items``: ids, as sorted strings, of items
    with an occurring window. ``near``: number of items with a window that occurs, or with one of
    ``width`` words of which one half occurs and all but one word of the other stand within ``slop``
    words of their places.
    """
    wins = shared.materialise(windows(benchmark, width))
    half = (width + 1) // 2
    # The window of a shorter item is looked up as a whole.
    first, second = F.slice("win", F.lit(1), F.lit(half)), F.slice("win", F.lit(half + 1), F.lit(width))
    part = lambda k, phrase, other: F.struct(F.lit(k).alias("part"), phrase.alias("phrase"), other.alias("other"))
    none = F.array().cast("array<string>")
    parts = F.when(F.size("win") == width, F.array(part(0, first, second), part(1, second, first))).otherwise(F.array(part(0, F.col("win"), none)))
    halves = shared.materialise(wins.select("win", F.explode(F.filter(parts, lambda p: F.size(p["phrase"]) > 0)).alias("p")).select("win", "p.*").distinct())
    hits = shared.stored(phrase_matches(tok, halves.select("phrase").distinct()), "halves")
    # Where the window begins, from the place of its half.
    begin = F.col("start") - F.when(F.col("part") == 1, F.size("other")).otherwise(0)
    placed = hits.join(bounded(halves), "phrase").select("row", "win", "part", "other", begin.alias("begin"))
    by_row = shared.materialise(placed.groupBy("row").agg(F.collect_list(F.struct("begin", "part", "win", "other")).alias("c")))
    w = F.col("w")

    def lost(c: Column) -> Column:
        """Words of the other half that are not near their places."""
        origin = c["begin"] + F.when(c["part"] == 0, F.size(c["win"]) - F.size(c["other"])).otherwise(0)
        # Positions are counted from 0; slices from 1, and never from before the text.
        low = lambda i: F.greatest(origin + i - slop, F.lit(0))
        high = lambda i: F.greatest(origin + i + slop + 1, F.lit(0))
        return F.size(F.filter(c["other"], lambda x, i: ~F.array_contains(F.slice(w, low(i) + 1, high(i) - low(i)), x)))

    whole = lambda c: (c["begin"] >= 0) & (F.slice(w, F.greatest(c["begin"], F.lit(0)) + 1, F.size(c["win"])) == c["win"])
    judged = F.transform("c", lambda c: F.struct(c["begin"].alias("begin"), c["win"].alias("win"), whole(c).alias("exact"), (lost(c) <= 1).alias("near")))
    checked = _with_words(tok, by_row).select("row", F.explode(judged).alias("m")).select("row", "m.*").where("exact or near").distinct()
    checked = shared.stored(checked, "windows-found")
    spread = checked.where("exact").select("row", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.size("win") - 1)).alias("pos"))
    n_hit = spread.distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = checked.select("row", "win", "exact").distinct().join(bounded(wins), "win").groupBy("row", "item_id").agg(F.max("exact").alias("exact"))
    items = named.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item_id").cast("string")))).alias("items"), F.count("*").alias("near"))
    return items.join(n_hit, "row", "left").select("row", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "items", "near")


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """All columns of the documents that hold no benchmark window; rows without an id stay.

    Windows that nearly occur don't count. Null and empty texts hold none and stay. Repeated rows go or
    stay together; a very long text is split into words like any other, and is one row of the scan.
    """
    key = "_copy"
    while key in docs.columns:
        key = f"_{key}"
    tok = tokens(docs)
    hit = shared.materialise(contamination(tok, benchmark, width).where("n_hit > 0").select("row"))
    found = tok.select("row", "doc_id", F.col("copy").alias(key)).join(bounded(hit), "row", "left_semi").drop("row").distinct()
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return rows.join(bounded(shared.materialise(found)), ["doc_id", key], "left_anti").select(*docs.columns)


def measure(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, items, near of every document that has an id.

    Null and empty texts have no words and no hits; a very long text is one array of words, about
    four times its size. Items without words have no windows. Repeated rows come out repeatedly, and
    rows that share an id are told apart by their texts. An empty table gives an empty result, an
    empty benchmark no hits; further columns are ignored.
    """
    tok = tokens(docs)
    found = shared.materialise(contamination(tok, benchmark, width, slop))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return tok.select("row", "doc_id", "n_words").join(bounded(found), "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), items.alias("items"), F.coalesce("near", F.lit(0)).cast("long").alias("near")
    )


def op8_positional_index(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near of every document."""
    found = measure(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.col("near").alias("n_near"),
    )


OP8_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, p, len(p) AS n FROM (SELECT item_id, list_slice(w, s, s + 9) AS p FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0))),
halves AS (
  SELECT item_id, p, n, if(n = 10, 5, n) AS m, 0 AS lead, if(n = 10, 5, n) AS other, if(n = 10, 5, 0) AS others, array_to_string(list_slice(p, 1, if(n = 10, 5, n)), ' ') AS g FROM win
  UNION ALL SELECT item_id, p, n, 5, 5, 0, 5, array_to_string(list_slice(p, 6, 10), ' ') FROM win WHERE n = 10),
sizes AS (SELECT DISTINCT m FROM halves),
grams AS (SELECT doc_id, s, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM w, sizes WHERE len(w) >= m)),
found AS (SELECT g.doc_id, g.s - t.lead AS s, t.item_id, t.p, t.n, t.other, t.others FROM grams g JOIN halves t ON g.g = t.g AND g.m = t.m),
judged AS (SELECT DISTINCT f.doc_id, f.s, f.item_id, f.n,
    f.s >= 1 AND list_slice(w.w, greatest(f.s, 1), f.s + f.n - 1) = f.p AS exact,
    len(list_filter(range(1, f.others + 1), lambda k: NOT coalesce(list_contains(list_slice(w.w, greatest(f.s + f.other + k - 1 - 2, 1), greatest(f.s + f.other + k - 1 + 2, 0)), f.p[f.other + k]), false))) <= 1 AS near
  FROM found f JOIN w ON f.doc_id = w.doc_id),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM judged WHERE exact) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM judged WHERE exact GROUP BY doc_id),
close AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM judged WHERE exact OR near GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM w LEFT JOIN pos ON w.doc_id = pos.doc_id LEFT JOIN its ON w.doc_id = its.doc_id LEFT JOIN close ON w.doc_id = close.doc_id
"""
