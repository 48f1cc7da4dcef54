"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import oracle, table, views
from ..operators import aggregates as A
from ..operators import masks
from ..operators import joins as J
from ..operators import project as P
from . import files as _files
from .joins import TIMES


def _timed(spark, sf_dir):
    (times,) = views(spark, sf_dir, "V_TIMES")
    return J.resolve_capture_time(times, ["manual", "exif", "xmp", "iptc"], "fs").withColumn("when", J.show_time(F.col("when")))


def a1_capture_span(spark, sf_dir):
    return A.capture_span(_timed(spark, sf_dir), F.lit("2030-01-01 00:00:00"))


def a2_fidelity_counts(spark, sf_dir):
    return A.fidelity_counts(P.decide_fidelity(views(spark, sf_dir, "V_IMAGES")[0], "high"), "doc")


def a3_compression_rollup(spark, sf_dir):
    decided = P.decide_recompression(_files.measured_images(spark, sf_dir), "balanced")
    return A.compression_rollup(decided, "doc")


def a4_batch_summary(spark, sf_dir):
    return A.batch_summary(views(spark, sf_dir, "V_RESULTS")[0])


def a5_warning_summary(spark, sf_dir):
    return A.warning_summary(views(spark, sf_dir, "V_WARN")[0])


def a6_compare_metrics(spark, sf_dir):
    (lines,) = views(spark, sf_dir, "V_LINES")
    texts = lines.groupBy("doc", "page", "side").agg(F.sum(F.xxhash64("line", "text").bitwiseAND(F.lit(0xFFFFFFFF))).cast("string").alias("t"))
    ours, ref = (texts.where(F.col("side") == s).select("doc", "page", F.col("t").alias(s)) for s in ("ours", "ref"))
    pages = ours.join(ref, ["doc", "page"], "full_outer").withColumn("iou", F.when(F.col("page") % 3 > 0, (F.col("page") % 7) / 10.0))
    a, b = (lines.where(F.col("side") == s).select("doc", "line", F.col("page").alias(f"p_{s}"), F.col("height").cast("double").alias(f"h_{s}"), F.col("text").alias(f"t_{s}")) for s in ("ours", "ref"))
    matches = a.join(b, ["doc", "line"]).where("t_ours = t_ref").select("doc", F.when(F.col("p_ours") == F.col("p_ref"), F.abs(F.col("h_ours") - F.col("line") % 50)).alias("offset"))
    return A.compare_metrics(matches, pages)


def a7_estimate_by_sample(spark, sf_dir):
    (paras,) = views(spark, sf_dir, "V_PARAS")
    return A.estimate_by_systematic_sample(paras, "doc_id", "ord", F.length("text"))


def a7_estimate_by_sample_whole(spark, sf_dir):
    """All paragraphs as one group, in stretches over all tasks."""
    (paras,) = views(spark, sf_dir, "V_PARAS")
    one = paras.select(F.lit("all").alias("batch"), F.struct("doc_id", "ord").alias("at"), F.length("text").alias("size"))
    return A.estimate_by_systematic_sample(one, "batch", "at", F.col("size"), spread=0)


def a8_set_parity(spark, sf_dir):
    (frags,) = views(spark, sf_dir, "V_FRAGS")
    return A.set_parity(frags.where("frag % 5 < 3"), frags.where("frag % 7 >= 3"), "page", "text")


def a9_mask_stats(spark, sf_dir):
    (masks,) = views(spark, sf_dir, "V_MASKS")
    return A.mask_stats(masks, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("mask")))


def a10_column_grid(spark, sf_dir):
    (cells,) = views(spark, sf_dir, "V_CELLS")
    own = cells.withColumns({"w": F.when(F.col("color") % 6 == 1, 0.0).otherwise(10.0 + F.col("color") % 40), "before": F.when(F.col("r") % 3 == 1, F.col("tbl") % 3), "after": F.col("r") % 2})
    declared = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tbl"), (F.col("n_nationkey") % 7 + 2).alias("n"), (F.col("n_nationkey") % 5 * 40.0).alias("known"))
    return A.column_grid(own, declared, 480.0, 10)


def a11_feature_census(spark, sf_dir):
    (tags,) = views(spark, sf_dir, "V_TAGS")
    tok = F.lower("tok")
    return A.feature_census(tags, "page_id", {"script": tok.startswith("<script"), "table": tok.startswith("<table"), "image": tok.startswith("<img"), "comment": tok.startswith("<!--"), "entity": F.col("tok").contains("&")})


def a9_mask_stats_words(spark, sf_dir):
    """Counts, boxes and overlap of dilated masks, on packed words throughout."""
    (cells,) = views(spark, sf_dir, "V_MASKS")
    words, keys = masks.pack(cells, "mask"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"))
    wide = masks.dilate(words, 70, 9)
    found = masks.stats(wide, keys).join(masks.overlap(words, wide, keys), "key")
    return found.select(F.col("key").alias("mask"), "n", "x0", "y0", "x1", "y1", "both", "either")


QUERIES = {f.__name__: f for f in (a1_capture_span, a2_fidelity_counts, a3_compression_rollup, a4_batch_summary, a5_warning_summary, a6_compare_metrics, a7_estimate_by_sample, a7_estimate_by_sample_whole, a8_set_parity, a9_mask_stats, a9_mask_stats_words, a10_column_grid, a11_feature_census)}

_P4 = _files.ORACLE_SQL["p4_decide_recompression"]
_P5 = _files.ORACLE_SQL["p5_decide_fidelity"]
_SKIPS = " || ".join(f"CASE WHEN count(*) FILTER (decision = 'skip:{s}') > 0 THEN ',{s}:' || count(*) FILTER (decision = 'skip:{s}') ELSE '' END" for s in A.SKIPS)

ORACLE_SQL = {
    "a1_capture_span": oracle(["V_TIMES"], TIMES + """, g AS (SELECT batch, min(shown) FILTER (source <> 'fs') AS earliest, max(shown) FILTER (source <> 'fs') AS latest, count(*) FILTER (source = 'fs') AS untrusted FROM best GROUP BY batch) SELECT *, coalesce(earliest, '2030-01-01 00:00:00') AS creation, earliest IS NOT NULL AS creation_is_capture, CASE WHEN untrusted > 0 THEN untrusted || ' without capture time' END AS warning FROM g"""),
    "a2_fidelity_counts": f"SELECT doc, fidelity, count(*) AS n FROM ({_P5}) GROUP BY doc, fidelity",
    "a3_compression_rollup": f"""WITH d AS (SELECT o.o_custkey AS doc, p.decision, 20000 + (o_orderkey * 31337) % 900000 AS stored_len, p.chosen_len FROM ({_P4}) p JOIN orders o ON o.o_orderkey = p.img), g AS (SELECT doc, count(*) FILTER (decision = 'replace') AS recompressed, count(*) FILTER (decision = 'kept') AS kept, count(*) FILTER (decision = 'optimal') AS optimal, count(*) FILTER (starts_with(decision, 'skip:')) AS skipped, ltrim({_SKIPS}, ',') AS skips, CAST(sum(stored_len) AS BIGINT) AS before, CAST(sum(chosen_len) AS BIGINT) AS a FROM d GROUP BY doc)
SELECT doc, recompressed, kept, optimal, skipped, skips, recompressed + kept + optimal + skipped = 0 AS is_mostly_vector, before, least(before, a) AS after, CASE WHEN before > 0 THEN round(1 - least(before, a) / before, 6) ELSE 0.0 END AS saved_ratio, a >= before AS unchanged FROM g""",
    "a4_batch_summary": oracle(["V_RESULTS"], """g AS (SELECT batch, count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (error IS NOT NULL) AS failed, arg_max(output, ord) FILTER (error IS NULL AND output IS NOT NULL) AS last_output, arg_min(error, ord) FILTER (error IS NOT NULL) AS first_error, CAST(coalesce(sum(before) FILTER (error IS NULL), 0) AS BIGINT) AS before, CAST(coalesce(sum(after) FILTER (error IS NULL), 0) AS BIGINT) AS after FROM V_RESULTS GROUP BY batch) SELECT *, CASE WHEN before > 0 THEN round(1 - after / before, 6) ELSE 0.0 END AS saved_ratio, succeeded = 0 AS batch_failed FROM g"""),
    "a5_warning_summary": oracle(["V_WARN"], """c AS (SELECT item, kind, detail, count(*) AS c FROM V_WARN GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item, kind ORDER BY detail) AS r FROM c) SELECT item, kind, CAST(sum(c) AS BIGINT) AS n, count(*) AS distinct_details, string_agg(detail, '; ' ORDER BY detail) FILTER (r <= 3) || CASE WHEN count(*) > 3 THEN ' …' ELSE '' END AS details FROM r GROUP BY item, kind"""),
    "a6_compare_metrics": oracle(["V_LINES"], """t AS (SELECT doc, page, side, string_agg(line || ':' || text, chr(10) ORDER BY line) AS t FROM V_LINES GROUP BY ALL), p AS (SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.page, b.page) AS page, a.t AS ours, b.t AS ref FROM (SELECT * FROM t WHERE side = 'ours') a FULL JOIN (SELECT * FROM t WHERE side = 'ref') b ON a.doc = b.doc AND a.page = b.page),
s AS (SELECT doc, count(ours) AS pages_ours, count(ref) AS pages_ref, count(*) FILTER (ours <> ref) AS d, round(coalesce(avg(CASE WHEN page % 3 > 0 THEN (page % 7) / 10.0 END), 1.0), 6) AS iou_mean, round(coalesce(min(CASE WHEN page % 3 > 0 THEN (page % 7) / 10.0 END), 1.0), 6) AS iou_min FROM p GROUP BY doc),
m AS (SELECT a.doc, CASE WHEN a.page = b.page THEN CAST(abs(a.height - a.line % 50) AS DOUBLE) END AS off FROM (SELECT * FROM V_LINES WHERE side = 'ours') a JOIN (SELECT * FROM V_LINES WHERE side = 'ref') b ON a.doc = b.doc AND a.line = b.line AND a.text = b.text), g AS (SELECT doc, count(*) AS matched, max(off) AS mx, list_sort(list(off) FILTER (off IS NOT NULL)) AS l FROM m GROUP BY doc)
SELECT s.doc, pages_ours, pages_ref, d + abs(pages_ours - pages_ref) AS differing, coalesce(matched, 0) AS matched, coalesce(l[len(l) // 2 + 1], 0.0) AS offset_median, coalesce(mx, 0.0) AS offset_max, iou_mean, iou_min FROM s LEFT JOIN g ON s.doc = g.doc"""),
    "a7_estimate_by_sample": oracle(["V_PARAS"], """n AS (SELECT doc_id, length(text) AS m, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS r FROM V_PARAS) SELECT doc_id, CAST(sum(m) FILTER (r % 8 = 0) * count(*) // count(*) FILTER (r % 8 = 0) AS BIGINT) AS estimate FROM n GROUP BY doc_id"""),
    "a7_estimate_by_sample_whole": oracle(["V_PARAS"], """n AS (SELECT length(text) AS m, row_number() OVER (ORDER BY doc_id, ord) - 1 AS r FROM V_PARAS) SELECT 'all' AS batch, CAST(sum(m) FILTER (r % 8 = 0) * count(*) // count(*) FILTER (r % 8 = 0) AS BIGINT) AS estimate FROM n"""),
    "a8_set_parity": oracle(["V_FRAGS"], """a AS (SELECT DISTINCT page, text FROM V_FRAGS WHERE frag % 5 < 3), b AS (SELECT DISTINCT page, text FROM V_FRAGS WHERE frag % 7 >= 3), j AS (SELECT coalesce(a.page, b.page) AS page, coalesce(a.text, b.text) AS text, a.page IS NULL AS la, b.page IS NULL AS lb FROM a FULL JOIN b ON a.page = b.page AND a.text = b.text) SELECT page, count(*) FILTER (la OR lb) = 0 AS equal, coalesce(string_agg(text, ',' ORDER BY text) FILTER (lb), '') AS only_a, coalesce(string_agg(text, ',' ORDER BY text) FILTER (la), '') AS only_b, count(*) FILTER (NOT la AND NOT lb) AS common FROM j GROUP BY page"""),
    "a9_mask_stats": oracle(["V_MASKS"], """b AS (SELECT mask, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM V_MASKS GROUP BY mask) SELECT vec_id AS mask, coalesce(n, 0) AS n, x0, y0, x1, y1 FROM embeddings LEFT JOIN b ON vec_id = mask"""),
    "a9_mask_stats_words": oracle(["V_MASKS"], """d AS (SELECT DISTINCT mask, x + dx AS x, y + dy AS y FROM V_MASKS, (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy) WHERE x + dx BETWEEN 0 AND 69 AND y + dy BETWEEN 0 AND 8), b AS (SELECT mask, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM d GROUP BY mask), o AS (SELECT mask, count(*) AS n FROM V_MASKS GROUP BY mask) SELECT vec_id AS mask, coalesce(b.n, 0) AS n, x0, y0, x1, y1, coalesce(o.n, 0) AS both, coalesce(b.n, 0) AS either FROM embeddings LEFT JOIN b ON vec_id = b.mask LEFT JOIN o ON vec_id = o.mask"""),
    "a10_column_grid": oracle(["V_CELLS"], """c AS (SELECT *, CASE WHEN color % 6 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(10 + color % 40 AS DOUBLE) END AS w, coalesce(sum(grid_span) OVER (PARTITION BY tbl, r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN r % 3 = 1 THEN tbl % 3 ELSE 0 END AS start FROM V_CELLS), d AS (SELECT n_nationkey AS tbl, n_nationkey % 7 + 2 AS n, CAST(n_nationkey % 5 * 40 AS DOUBLE) AS known FROM nation), need AS (SELECT tbl, max(start + grid_span + r % 2) AS need FROM c GROUP BY tbl), f AS (SELECT c.tbl, start, arg_min(w, {'r': r, 'c': c}) AS w FROM c JOIN d ON c.tbl = d.tbl WHERE start >= n AND grid_span = 1 AND w > 0 GROUP BY c.tbl, start), s AS (SELECT tbl, count(*) AS found, sum(w) AS fw FROM f GROUP BY tbl), j AS (SELECT d.tbl, CAST(greatest(need, n) AS BIGINT) AS columns, known + coalesce(fw, 0) AS known, greatest(need, n) - n - coalesce(found, 0) AS unknown FROM d JOIN need ON d.tbl = need.tbl LEFT JOIN s ON d.tbl = s.tbl)
SELECT tbl, columns, round(known, 6) AS known, round(CASE WHEN unknown > 0 THEN greatest((480.0 - known) / unknown, 18.0) END, 6) AS share, columns > 10 AS placeholder FROM j"""),
    "a11_feature_census": oracle(["V_TAGS"], """c AS (SELECT page_id, count(*) FILTER (starts_with(lower(tok), '<script')) AS script, count(*) FILTER (starts_with(lower(tok), '<table')) AS "table", count(*) FILTER (starts_with(lower(tok), '<img')) AS image, count(*) FILTER (starts_with(lower(tok), '<!--')) AS comment, count(*) FILTER (contains(tok, '&')) AS entity FROM V_TAGS GROUP BY page_id) SELECT page_id, feature, n FROM (UNPIVOT c ON script, "table", image, comment, entity INTO NAME feature VALUE n) WHERE n > 0"""),
}
