"""Queries over ordered sequences, isolation and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import oracle, table, views
from ..operators import isolate as I
from ..operators import joins as J
from ..operators import project as P
from ..operators import sequence as W
from ..streaming import expiring as X
from ..streaming import progress as T
from .joins import TIMES


def _numbered(spark, sf_dir):
    items, levels = views(spark, sf_dir, "V_ITEMS", "V_LEVELS")
    levels = levels.select("abs", "ilvl", "start", "fmt", "lvl_text", F.col("restart").cast("int").alias("restart"), "legal")
    over = spark.createDataFrame([(2, 0, 5)], "num_id int, ilvl int, start int")
    return W.number_items(items, levels, over), levels


def w1_number_items(spark, sf_dir):
    return _numbered(spark, sf_dir)[0].select("doc_id", "ord", "num_id", "ilvl", "value")


def w1_number_items_whole(spark, sf_dir):
    """All documents as one list, in stretches over all tasks."""
    items, levels = views(spark, sf_dir, "V_ITEMS", "V_LEVELS")
    one = items.withColumn("ord", F.col("doc_id") * 1_000_000 + F.col("ord")).withColumn("doc_id", F.lit(0).cast("long"))
    levels = levels.select("abs", "ilvl", "start", F.col("restart").cast("int").alias("restart"))
    over = spark.createDataFrame([(2, 0, 5)], "num_id int, ilvl int, start int")
    return W.number_items(one, levels, over, 0).select("ord", "num_id", "ilvl", "value")


def w2_expand_labels(spark, sf_dir):
    numbered, levels = _numbered(spark, sf_dir)
    return W.expand_labels(numbered, levels)


def w3_script_runs(spark, sf_dir):
    return W.script_runs(views(spark, sf_dir, "V_TEXT")[0])


def w3_script_runs_both(spark, sf_dir):
    return W.script_runs(views(spark, sf_dir, "V_TEXT")[0], "both")


def w3_script_runs_hinted(spark, sf_dir):
    """Lines as spans, every second one under an East Asian hint."""
    (paras,) = views(spark, sf_dir, "V_PARAS")
    text = F.translate("text", "aeo0123456789", "中文字〇一二三四五六七八九")
    spans = paras.where("length(text) > 0").select("doc_id", "ord", text.alias("text"), (F.col("ord") % 2 == 1).alias("hint"))
    return W.script_runs(W.hinted_text(spans))


def w4_merge_equal_runs(spark, sf_dir):
    return W.merge_equal_runs(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_type"])


def w4_merge_equal_runs_whole(spark, sf_dir):
    """All events as one sequence, in stretches over all tasks."""
    events = table(spark, sf_dir, "events").withColumn("all", F.lit("all"))
    return W.merge_equal_runs(events, "all", "event_id", ["event_type"], 0).drop("all")


def w5_suppress_between_equal(spark, sf_dir):
    (paras,) = views(spark, sf_dir, "V_PARAS")
    return W.suppress_between_equal(paras, "doc_id", "ord", "style", "contextual").select("doc_id", "ord", "space_before", "space_after")


def w6_running_offsets(spark, sf_dir):
    (paras,) = views(spark, sf_dir, "V_PARAS")
    return W.running_offsets(paras.withColumn("height", F.length("text") % 40), "doc_id", "ord", True).select("doc_id", "ord", "gap", "offset")


def w6_running_offsets_whole(spark, sf_dir):
    """All paragraphs as one story, in stretches over all tasks."""
    (paras,) = views(spark, sf_dir, "V_PARAS")
    one = paras.select("doc_id", "ord", "space_before", "space_after", (F.length("text") % 40).alias("height"), F.lit("all").alias("story"), F.struct("doc_id", "ord").alias("at"))
    return W.running_offsets(one, "story", "at", True, 0).select("doc_id", "ord", "gap", "offset")


def w7_pack_tokens(spark, sf_dir):
    return W.pack_tokens(views(spark, sf_dir, "V_TOKENS")[0], 40)


def w8_pack_pages(spark, sf_dir):
    """Without rules: lines on pages of height 200."""
    (lines,) = views(spark, sf_dir, "V_LINES")
    return W.pack_pages(lines.where("side = 'ours'").select("doc", F.col("line").alias("para"), F.lit(0).alias("line"), "height"), 200.0, False)


def w8_pack_pages_rules(spark, sf_dir):
    (lines,) = views(spark, sf_dir, "V_LINES")
    own = lines.where("side = 'ours'").select("doc", F.floor(F.col("line") / 5).alias("para"), (F.col("line") % 5).alias("line"), "height", (F.col("line") % 23 == 7).alias("break_after"), F.lit(True).alias("widow_control"), (F.floor(F.col("line") / 5) % 3 == 1).alias("keep_lines"), (F.floor(F.col("line") / 5) % 4 == 2).alias("keep_next"), F.lit(6.0).alias("space_before"), F.lit(4.0).alias("space_after"))
    return W.pack_pages(own, 200.0)


def w9_page_numbers(spark, sf_dir):
    (sections,) = views(spark, sf_dir, "V_SECTIONS")
    return W.page_numbers(sections.select("doc", "sec", "start", "restart", "pages", (F.col("sec") % 2 == 0).alias("title_page"), (F.col("doc") % 3 == 0).alias("even_odd")))


def w10_inherit_headers(spark, sf_dir):
    (sections,) = views(spark, sf_dir, "V_SECTIONS")
    content = sections.select(F.explode(F.array("hdr_default", "hdr_first")).alias("ref")).where("ref is not null and ref <> 'd6'").distinct().withColumn("body", F.upper("ref"))
    return W.inherit_headers(sections, ["hdr_default", "hdr_first"], content)


_CODES = ["PAGE", "NUMPAGES \\* ROMAN", "SECTIONPAGES \\* alphabetic", "PAGE \\* roman", "DATE"]


def w11_substitute_fields(spark, sf_dir):
    (sections,) = views(spark, sf_dir, "V_SECTIONS")
    pages = sections.select("doc", F.col("sec"), F.explode(F.sequence(F.lit(1), "pages")).alias("i"))
    pages = pages.select("doc", "sec", (F.col("sec") * 1000 + F.col("i")).alias("page"), (F.col("i") + F.col("sec")).cast("int").alias("number"))
    codes = F.element_at(F.array(*(F.lit(c) for c in _CODES)), ((F.col("page") + F.col("span")) % 5 + 1).cast("int"))
    spans = pages.select("doc", "page", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("span"))
    field = F.when(F.col("span") < 3, F.when(F.col("span") < 2, 0).otherwise(1))
    spans = spans.select("doc", "page", "span", field.alias("field"), F.when(F.col("span") < 3, codes).alias("code"), F.concat(F.lit("t"), F.col("span").cast("string")).alias("text"))
    return W.substitute_fields(spans, pages)


def w12_group_by_anchor(spark, sf_dir):
    return W.group_by_anchor(views(spark, sf_dir, "V_FRAGS")[0])


def w13_strip_subtrees(spark, sf_dir):
    return W.strip_subtrees(views(spark, sf_dir, "V_TAGS")[0], ["script", "style", "p"])


def w14_choose_alternative(spark, sf_dir):
    return W.choose_alternative(views(spark, sf_dir, "V_ALTS")[0], ["wps"])


def w15_grid_positions(spark, sf_dir):
    return W.grid_positions(views(spark, sf_dir, "V_CELLS")[0])


def w16_fill_from_first(spark, sf_dir):
    (times,) = views(spark, sf_dir, "V_TIMES")
    found = J.resolve_capture_time(times, ["manual", "exif", "xmp", "iptc"], "fs").select("batch", "ord", "file", J.show_time(F.col("when")).alias("shown"))
    return W.fill_from_first(found, "batch", "ord", "shown")


def o2_sort_by_time(spark, sf_dir):
    (times,) = views(spark, sf_dir, "V_TIMES")
    found = J.resolve_capture_time(times.withColumn("fs", F.when(F.col("file") % 4 > 0, F.col("fs"))), ["manual", "exif"], "fs")
    return P.sort_by_time(found, "when", "ord").select("file", J.show_time(F.col("when")).alias("shown"), "place")


def _check(row):
    if row["n"] % 7 == 0:
        raise ValueError(f"bad size {row['n']}")
    return str(row["n"] * 2), row["lang"]


def e1_map_isolated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("n_chars").alias("n"), "lang")
    return I.map_isolated(docs, _check)


def t1_latest_progress(spark, sf_dir):
    events = T.event_stream(spark, sf_dir)
    shaped = events.select(F.col("user_id").alias("job"), "ts", "event_id", F.col("event_type").alias("stage"), (F.col("event_id") % 10).alias("index"), F.lit(8).alias("count"), ((F.col("event_id") % 4) / 4.0).alias("done"))
    return T.run_to_end(T.latest_progress(shaped), "update", ["job"])


def t1_newest_progress_days(spark, sf_dir):
    """The same, but jobs that are silent for 400 days are forgotten."""
    events = T.event_stream(X.expiring_session(spark), sf_dir)
    shaped = events.select(F.col("user_id").alias("job"), "ts", "event_id", F.col("event_type").alias("stage"), (F.col("event_id") % 10).alias("index"), F.lit(8).alias("count"), ((F.col("event_id") % 4) / 4.0).alias("done"))
    return T.run_to_end(X.newest_progress(shaped, 400), "update", ["job"])


def t2_warnings_once_days(spark, sf_dir):
    """Every warning, but not again within three days of when it was last said."""
    events = T.event_stream(X.expiring_session(spark), sf_dir).select(F.col("user_id").alias("item"), F.col("event_type").alias("detail"), F.col("ts").cast("timestamp").alias("ts"))
    said = T.run_to_end(X.warnings_once(events, 3), "append")
    return said.select("item", "detail", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


def t2_distinct_warnings(spark, sf_dir):
    events = T.event_stream(spark, sf_dir).select(F.col("user_id").alias("item"), F.col("event_type").alias("detail"), F.col("ts").cast("timestamp").alias("ts"))
    return T.run_to_end(T.distinct_warnings(events, "3650 days"), "append").select("item", "detail")


def t3_running_tally(spark, sf_dir):
    events = T.event_stream(spark, sf_dir)
    shaped = events.select(F.col("event_type").alias("batch"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("err"), (F.col("event_id") % 3).cast("string"))).alias("error"))
    return T.run_to_end(T.running_tally(shaped), "complete", ["batch"])


QUERIES = {
    f.__name__: f
    for f in (w1_number_items, w1_number_items_whole, w2_expand_labels, w3_script_runs, w3_script_runs_both, w3_script_runs_hinted, w4_merge_equal_runs, w4_merge_equal_runs_whole, w5_suppress_between_equal, w6_running_offsets, w6_running_offsets_whole, w7_pack_tokens, w8_pack_pages, w8_pack_pages_rules, w9_page_numbers, w10_inherit_headers, w11_substitute_fields, w12_group_by_anchor, w13_strip_subtrees, w14_choose_alternative, w15_grid_positions, w16_fill_from_first, o2_sort_by_time, e1_map_isolated, t1_latest_progress, t1_newest_progress_days, t2_distinct_warnings, t2_warnings_once_days, t3_running_tally)
}

#: Level 1 and 2 restart after level 0; level 2 has restart 1, which names level 0 alone.
_W1 = """s AS (SELECT *, CASE ilvl WHEN 1 THEN sum(CASE WHEN ilvl < 1 THEN 1 ELSE 0 END) OVER w WHEN 2 THEN sum(CASE WHEN ilvl < 1 THEN 1 ELSE 0 END) OVER w ELSE 0 END AS seg, sum(CASE WHEN ilvl < 1 THEN 1 ELSE 0 END) OVER w AS seg_all FROM V_ITEMS WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
a AS (SELECT *, num_id = 2 AND ilvl = 0 AND row_number() OVER (PARTITION BY doc_id, num_id, ilvl ORDER BY ord) = 1 AS o, row_number() OVER (PARTITION BY doc_id, ilvl, seg ORDER BY ord) = 1 AS f FROM s),
b AS (SELECT *, sum(CASE WHEN o OR f THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, ilvl, seg ORDER BY ord) AS island FROM a),
v AS (SELECT *, CAST(first_value(CASE WHEN o THEN 5 WHEN ilvl = 2 THEN 3 ELSE 1 END) OVER i + row_number() OVER i - 1 AS INT) AS value FROM b WINDOW i AS (PARTITION BY doc_id, ilvl, seg, island ORDER BY ord))"""

_T1 = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id AS job, event_id, event_type AS stage, round(least((event_id % 10 + (event_id % 4) / CAST(4.0 AS DOUBLE)) / 8, CAST(1 AS DOUBLE)), 6) AS overall FROM r WHERE n = 1"""


def _roman_sql(n: str) -> str:
    """Roman numerals up to 3999 from the digits of ``n``."""
    place = lambda d, one, five, ten: f"list_extract(['', '{one}', '{one*2}', '{one*3}', '{one}{five}', '{five}', '{five}{one}', '{five}{one*2}', '{five}{one*3}', '{one}{ten}'], CAST({n} // {d} % 10 + 1 AS INT))"
    return f"(repeat('M', CAST({n} // 1000 AS INT)) || {place(100, 'C', 'D', 'M')} || {place(10, 'X', 'L', 'C')} || {place(1, 'I', 'V', 'X')})"


def _letter_sql(n: str) -> str:
    return f"repeat(chr(CAST(97 + ({n} - 1) % 26 AS INT)), CAST(({n} - 1) // 26 + 1 AS INT))"


def _class_sql(ranges: str) -> str:
    return f"regexp_matches(ch, '^[{ranges}]')"


_SCRIPTS = lambda names: "".join(rf"\p{{{n}}}" for n in names if n != "Unknown")
_CLASS = f"k AS (SELECT doc_id, pos, CASE WHEN {_class_sql(W.NEITHER)} THEN NULL WHEN {_class_sql(W.LATIN)} THEN 'latin' WHEN {_class_sql(W.EAST_ASIAN)} THEN 'east_asian' WHEN {_class_sql(_SCRIPTS(W.EAST_ASIAN_SCRIPTS))} THEN 'east_asian' WHEN {_class_sql(_SCRIPTS(W.NO_SCRIPTS))} THEN NULL ELSE 'latin' END AS own FROM V_CHARS)"
_HINTED = _CLASS.replace("V_CHARS", "h").replace("CASE WHEN", f"CASE WHEN hint AND ({_class_sql(W.HINTED)} OR ({_class_sql(W.NEITHER)} OR {_class_sql(_SCRIPTS(W.NO_SCRIPTS))}) AND NOT {_class_sql(W.LATIN)} AND NOT {_class_sql(W.EAST_ASIAN)} AND NOT regexp_matches(ch, '^[\\p{{Cc}}\\p{{M}}\\x{{20}}\\x{{A0}}]')) THEN 'east_asian' WHEN", 1)
_RUNS = """n AS (SELECT *, sum(CASE WHEN pc IS NULL OR pc <> class THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, lag(class) OVER (PARTITION BY doc_id ORDER BY pos) AS pc FROM c)) SELECT doc_id, CAST(min(pos) AS INT) AS start, CAST(max(pos) + 1 AS INT) AS "end", any_value(class) AS class FROM n GROUP BY doc_id, run"""

ORACLE_SQL = {
    "w1_number_items": oracle(["V_ITEMS"], _W1 + " SELECT doc_id, ord, num_id, ilvl, value FROM v"),
    "w1_number_items_whole": oracle(["V_ITEMS"], "one AS (SELECT CAST(0 AS BIGINT) AS doc_id, doc_id * 1000000 + ord AS ord, num_id, ilvl, abs FROM V_ITEMS), " + _W1.replace("V_ITEMS", "one") + " SELECT ord, num_id, ilvl, value FROM v"),
    "w2_expand_labels": oracle(["V_ITEMS"], _W1 + f""", p AS (SELECT *, last_value(CASE WHEN ilvl = 0 THEN value END IGNORE NULLS) OVER w AS v0, last_value(CASE WHEN ilvl = 1 THEN value END IGNORE NULLS) OVER w1 AS v1 FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w1 AS (PARTITION BY doc_id, seg_all ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, ord, ilvl, value, CASE ilvl WHEN 0 THEN {_roman_sql('value')} || '.' WHEN 1 THEN {_roman_sql('coalesce(v0, 1)')} || '.' || value ELSE '(' || {_letter_sql('value')} || ')' END AS label, false AS fallback FROM p"""),
    "w3_script_runs": oracle(["V_CHARS"], _CLASS + ", c AS (SELECT doc_id, pos, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'latin') AS class FROM k), " + _RUNS),
    "w3_script_runs_both": oracle(["V_CHARS"], _CLASS + ", c AS (SELECT doc_id, pos, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'latin') AS class FROM k), " + _RUNS),
    "w3_script_runs_hinted": oracle(["V_PARAS"], "u AS (SELECT doc_id, ord, generate_subscripts(a, 1) AS i, unnest(a) AS ch FROM (SELECT doc_id, ord, string_split(translate(text, 'aeo0123456789', '中文字〇一二三四五六七八九'), '') AS a FROM V_PARAS WHERE length(text) > 0)), h AS (SELECT doc_id, ord % 2 = 1 AS hint, row_number() OVER (PARTITION BY doc_id ORDER BY ord, i) - 1 AS pos, ch FROM u), " + _HINTED + ", c AS (SELECT doc_id, pos, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'latin') AS class FROM k), " + _RUNS),
    "w4_merge_equal_runs": """WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events), r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM l) SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY user_id, event_type, run""",
    "w4_merge_equal_runs_whole": """WITH l AS (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS p FROM events), r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS run FROM l) SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY event_type, run""",
    "w5_suppress_between_equal": oracle(["V_PARAS"], """n AS (SELECT *, lag(style) OVER w AS p, lead(style) OVER w AS q FROM V_PARAS WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) SELECT doc_id, ord, CASE WHEN contextual AND p = style THEN 0 ELSE space_before END AS space_before, CASE WHEN contextual AND q = style THEN 0 ELSE space_after END AS space_after FROM n"""),
    "w6_running_offsets": oracle(["V_PARAS"], """g AS (SELECT doc_id, ord, space_after, length(text) % 40 AS height, greatest(space_before - coalesce(lag(space_after) OVER (PARTITION BY doc_id ORDER BY ord), 0), 0) AS gap FROM V_PARAS) SELECT doc_id, ord, gap, CAST(coalesce(sum(gap + height + space_after) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + gap AS BIGINT) AS "offset" FROM g"""),
    "w6_running_offsets_whole": oracle(["V_PARAS"], """g AS (SELECT doc_id, ord, space_after, length(text) % 40 AS height, greatest(space_before - coalesce(lag(space_after) OVER (ORDER BY doc_id, ord), 0), 0) AS gap FROM V_PARAS) SELECT doc_id, ord, gap, CAST(coalesce(sum(gap + height + space_after) OVER (ORDER BY doc_id, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + gap AS BIGINT) AS "offset" FROM g"""),
    "w7_pack_tokens": oracle(["V_TOKENS"], """q AS (SELECT doc_id, pos, contains(tok, chr(10)) AS br, replace(tok, chr(10), '') AS t FROM V_TOKENS), z AS (SELECT *, CASE WHEN length(t) > 0 AND contains('.,;:!?)', right(t, 1)) THEN 1 ELSE 0 END AS c FROM q), y AS (SELECT *, greatest(CAST(ceil((length(t) - c - 40) / 40) AS INT), 0) AS cuts FROM z),
x AS (SELECT doc_id, pos, br AND k = cuts AS br, CASE WHEN k < cuts THEN 40 ELSE length(t) - 40 * cuts END AS len, CASE WHEN k < cuts THEN 40 ELSE length(t) - 40 * cuts - c END AS shown, k, cuts FROM (SELECT *, unnest(range(0, cuts + 1)) AS k FROM y)),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) AS i FROM x),
f(doc_id, i, line, used, open, pos, len) AS (SELECT doc_id, CAST(1 AS BIGINT), 0, CAST(len AS BIGINT), NOT br AND NOT k < cuts, pos, len FROM w WHERE i = 1 UNION ALL SELECT w.doc_id, w.i, CASE WHEN f.open AND k = 0 AND cuts = 0 AND f.used + 1 + w.shown <= 40 THEN f.line ELSE f.line + 1 END, CASE WHEN f.open AND k = 0 AND cuts = 0 AND f.used + 1 + w.shown <= 40 THEN f.used + 1 + w.len ELSE w.len END, NOT w.br AND NOT k < cuts, w.pos, w.len FROM f JOIN w ON w.doc_id = f.doc_id AND w.i = f.i + 1)
SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(min(pos) AS BIGINT) AS first, CAST(max(pos) AS BIGINT) AS last, max(used) AS used FROM f GROUP BY doc_id, line""", True),
    "w8_pack_pages": oracle(["V_LINES"], """l AS (SELECT doc, line, height, row_number() OVER (PARTITION BY doc ORDER BY line) AS i FROM V_LINES WHERE side = 'ours'), f(doc, i, line, page, used) AS (SELECT doc, i, line, CAST(0 AS BIGINT), height FROM l WHERE i = 1 UNION ALL SELECT l.doc, l.i, l.line, CASE WHEN f.used + l.height > 200.001 THEN f.page + 1 ELSE f.page END, CASE WHEN f.used + l.height > 200.001 THEN l.height ELSE f.used + l.height END FROM f JOIN l ON l.doc = f.doc AND l.i = f.i + 1) SELECT doc, CAST(line AS BIGINT) AS para, CAST(0 AS BIGINT) AS line, page FROM f""", True),
    "w8_pack_pages_rules": oracle(["V_LINES"], """l AS (SELECT doc, CAST(floor(line / 5) AS BIGINT) AS para, line % 5 AS k, line, height AS h, line % 23 = 7 AS brk FROM V_LINES WHERE side = 'ours'),
d AS (SELECT *, count(*) OVER q - row_number() OVER (PARTITION BY doc, para ORDER BY k) + 1 AS n, row_number() OVER (PARTITION BY doc, para ORDER BY k) - 1 AS i, sum(h) OVER q AS total, lead(h, 1) OVER o AS h1, lead(h, 2) OVER o AS h2, coalesce(lead(brk, 1) OVER o, false) AS brk1, row_number() OVER (PARTITION BY doc ORDER BY line) AS r FROM l WINDOW q AS (PARTITION BY doc, para), o AS (PARTITION BY doc, para ORDER BY k)),
g AS (SELECT doc, para, any_value(total) AS total, arg_min(h, k) AS first FROM d GROUP BY doc, para),
e AS (SELECT d.*, CASE WHEN d.para % 4 = 2 AND i = 0 THEN 10 + d.total + coalesce(6 + g.first, 0) END AS chain FROM d LEFT JOIN g ON g.doc = d.doc AND g.para = d.para + 1),
f(doc, r, page, used, here, spot) AS (
SELECT doc, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM e GROUP BY doc
UNION ALL SELECT doc, r, at2 + CASE WHEN brk THEN 1 ELSE 0 END, CASE WHEN brk THEN 0 WHEN n = 1 THEN u3 + 4 ELSE u3 END, CASE WHEN brk THEN 0 ELSE here2 END, at2 FROM (
 SELECT *, at1 + CASE WHEN turn THEN 1 ELSE 0 END AS at2, CASE WHEN turn THEN h ELSE u2 + h END AS u3, CASE WHEN turn THEN 1 ELSE here1 + 1 END AS here2 FROM (
  SELECT *, NOT (u2 <= 0 OR u2 + h <= 200.001) OR (i = 0 AND u2 > 0 AND NOT brk AND coalesce(u2 + h + h1 > 200.001 OR (n = 3 AND NOT brk1 AND u2 + h + h1 + h2 > 200.001), false)) OR (n = 2 AND here1 > 0 AND NOT brk AND u2 + h + h1 > 200.001) AS turn FROM (
   SELECT *, CASE WHEN i > 0 THEN used WHEN moved THEN 0 ELSE used + 6 END AS u2, page + CASE WHEN moved THEN 1 ELSE 0 END AS at1, CASE WHEN i = 0 THEN 0 ELSE here END AS here1 FROM (
    SELECT e.*, f.page, f.used, f.here, e.i = 0 AND f.used > 0 AND (coalesce(f.used + e.chain > 200.001, false) OR (e.para % 3 = 1 AND f.used + 6 + e.total > 200.001)) AS moved FROM f JOIN e ON e.doc = f.doc AND e.r = f.r + 1)))))
SELECT f.doc, e.para, CAST(e.k AS BIGINT) AS line, f.spot AS page FROM f JOIN e ON e.doc = f.doc AND e.r = f.r""", True),
    "w9_page_numbers": oracle(["V_SECTIONS"], """s AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY sec) AS i FROM V_SECTIONS), f(doc, i, sec, joins, lo, blank, pages, made, n) AS (
SELECT doc, CAST(1 AS BIGINT), sec, false, coalesce(restart, 1), (start = 'odd' AND coalesce(restart, 1) % 2 = 0) OR (start = 'even' AND coalesce(restart, 1) % 2 = 1), pages, 0, coalesce(restart, 1) + pages - 1 + CASE WHEN (start = 'odd' AND coalesce(restart, 1) % 2 = 0) OR (start = 'even' AND coalesce(restart, 1) % 2 = 1) THEN 1 ELSE 0 END FROM s WHERE i = 1
UNION ALL SELECT doc, i, sec, joins, lo, blank, pg, made, lo + pg - 1 + CASE WHEN blank THEN 1 ELSE 0 END FROM (SELECT *, (start = 'odd' AND lo % 2 = 0) OR (start = 'even' AND lo % 2 = 1) AS blank FROM (SELECT s.doc, s.i, s.sec, s.start, s.start = 'continuous' AS joins, CASE WHEN s.start = 'continuous' THEN f.n + 1 ELSE coalesce(s.restart, f.n + 1) END AS lo, CASE WHEN s.start = 'continuous' THEN s.pages - 1 ELSE s.pages END AS pg, f.made + f.pages + CASE WHEN f.blank THEN 1 ELSE 0 END AS made FROM f JOIN s ON s.doc = f.doc AND s.i = f.i + 1))),
g AS (SELECT *, unnest(range(CASE WHEN blank THEN -1 ELSE 0 END, pages)) AS k FROM f)
SELECT doc, CAST(made + k + CASE WHEN blank THEN 1 ELSE 0 END AS INT) AS page, sec, CAST(lo + k + CASE WHEN blank THEN 1 ELSE 0 END AS INT) AS number, CASE WHEN k < 0 THEN 'blank' WHEN k = 0 AND NOT joins AND sec % 2 = 0 THEN 'first' WHEN doc % 3 = 0 AND (lo + k + CASE WHEN blank THEN 1 ELSE 0 END) % 2 = 0 THEN 'even' ELSE 'default' END AS kind FROM g""", True),
    "w10_inherit_headers": oracle(["V_SECTIONS"], """h AS (SELECT doc, sec, last_value(hdr_default IGNORE NULLS) OVER w AS d, last_value(hdr_first IGNORE NULLS) OVER w AS f FROM V_SECTIONS WINDOW w AS (PARTITION BY doc ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT doc, sec, CASE WHEN d <> 'd6' THEN upper(d) END AS hdr_default, CASE WHEN f <> 'd6' THEN upper(f) END AS hdr_first FROM h"""),
    "w11_substitute_fields": oracle(["V_SECTIONS"], f"""p AS (SELECT doc, sec, sec * 1000 + i AS page, i + sec AS number FROM (SELECT doc, sec, unnest(range(1, pages + 1)) AS i FROM V_SECTIONS)), t AS (SELECT *, count(*) OVER (PARTITION BY doc) AS np, count(*) OVER (PARTITION BY doc, sec) AS sp FROM p), s AS (SELECT *, unnest(range(0, 4)) AS span FROM t), c AS (SELECT *, CASE WHEN span < 3 THEN (page + span) % 5 END AS code, CASE WHEN span < 2 THEN 0 WHEN span < 3 THEN 1 END AS field FROM s)
SELECT doc, page, CAST(span AS INT) AS span, CASE code WHEN 0 THEN CAST(number AS VARCHAR) WHEN 1 THEN {_roman_sql('np')} WHEN 2 THEN {_letter_sql('sp')} WHEN 3 THEN lower({_roman_sql('number')}) ELSE 't' || span END AS text FROM c WHERE span <> 1 OR code = 4"""),
    "w12_group_by_anchor": oracle(["V_FRAGS"], """r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y DESC, x, frag) AS i FROM V_FRAGS), f(page, i, line, anchor) AS (SELECT page, i, CAST(0 AS BIGINT), y FROM r WHERE i = 1 UNION ALL SELECT r.page, r.i, CASE WHEN abs(f.anchor - r.y) <= CAST(0.5 AS DOUBLE) THEN f.line ELSE f.line + 1 END, CASE WHEN abs(f.anchor - r.y) <= CAST(0.5 AS DOUBLE) THEN f.anchor ELSE r.y END FROM f JOIN r ON r.page = f.page AND r.i = f.i + 1) SELECT f.page, f.line, any_value(anchor) AS y, min(x) AS x0, max(x) AS x1, string_agg(text, '' ORDER BY x, frag) AS text FROM f JOIN r ON r.page = f.page AND r.i = f.i GROUP BY f.page, f.line""", True),
    "w14_choose_alternative": oracle(["V_ALTS"], """SELECT grp, opt, requires FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN requires = '' THEN 1 ELSE 0 END, opt) AS n FROM V_ALTS WHERE requires IN ('', 'wps')) WHERE n = 1"""),
    "w15_grid_positions": oracle(["V_CELLS"], """p AS (SELECT *, coalesce(sum(grid_span) OVER (PARTITION BY tbl, r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM V_CELLS), m AS (SELECT *, coalesce(v_merge = 'continue' AND lag(r) OVER (PARTITION BY tbl, start ORDER BY r) = r - 1, false) AS j FROM p), g AS (SELECT *, sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY tbl, start ORDER BY r) AS run FROM m) SELECT tbl, CAST(start AS BIGINT) AS start, min(r) AS r, arg_min(c, r) AS c, count(*) AS row_span FROM g GROUP BY tbl, start, run"""),
    "w16_fill_from_first": oracle(["V_TIMES"], TIMES + " SELECT batch, ord, file, first_value(shown) OVER (PARTITION BY batch ORDER BY ord) AS shown, 'manual' AS source FROM best"),
    "o2_sort_by_time": oracle(["V_TIMES"], """t AS (SELECT file, CASE WHEN manual IS NOT NULL THEN '2024-03-15 14:30:22' WHEN file % 3 = 1 THEN replace(exif, 'T', ' ') WHEN file % 4 > 0 THEN fs END AS shown FROM V_TIMES) SELECT file, shown, row_number() OVER (ORDER BY shown ASC NULLS FIRST, file) AS place FROM t"""),
    "e1_map_isolated": """SELECT doc_id AS ord, CASE WHEN n_chars % 7 <> 0 THEN CAST(n_chars * 2 AS VARCHAR) END AS output, CASE WHEN n_chars % 7 = 0 THEN 'ValueError: bad size ' || n_chars END AS error, CASE WHEN n_chars % 7 <> 0 THEN lang END AS detail FROM documents""",
    "t1_latest_progress": _T1,
    "t1_newest_progress_days": _T1,
    "t2_warnings_once_days": """WITH RECURSIVE w AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY user_id, event_type UNION ALL SELECT w.user_id, w.event_type, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.ts >= w.ts + INTERVAL 3 DAY GROUP BY w.user_id, w.event_type, w.ts) SELECT user_id AS item, event_type AS detail, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM w""",
    "t2_distinct_warnings": "SELECT DISTINCT user_id AS item, event_type AS detail FROM events",
    "t3_running_tally": """SELECT event_type AS batch, count(*) FILTER (event_id % 7 <> 0) AS succeeded, count(*) FILTER (event_id % 7 = 0) AS failed, arg_min('err' || event_id % 3, event_id) FILTER (event_id % 7 = 0) AS first_error FROM events GROUP BY event_type""",
}


def _strip_sql(names: list[str]) -> str:
    """One pass for each name over the tokens that the pass before left."""
    source, parts = "V_TAGS", []
    for i, name in enumerate(names):
        parts.append(f"""c{i} AS (SELECT page_id, pos, tok, sum(CASE WHEN regexp_matches(lower(tok), '^<{name}(\\s[^>]*)?>$') AND NOT regexp_matches(tok, '/>$') THEN 1 WHEN regexp_matches(lower(tok), '^</{name}\\s*>$') THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS c FROM {source}), d{i} AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY page_id ORDER BY pos)) AS d FROM c{i}), e{i} AS (SELECT *, lag(d, 1, 0) OVER (PARTITION BY page_id ORDER BY pos) AS b FROM d{i}), k{i} AS (SELECT page_id, pos, tok FROM e{i} WHERE d = 0 AND b = 0)""")
        source = f"k{i}"
    return ", ".join(parts) + f" SELECT page_id, pos, tok FROM {source}"


ORACLE_SQL["w13_strip_subtrees"] = oracle(["V_TAGS"], _strip_sql(["script", "style", "p"]))
