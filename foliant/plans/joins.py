"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import oracle, table, views
from ..operators import joins as J


def j1_resolve_capture_time(spark, sf_dir):
    (times,) = views(spark, sf_dir, "V_TIMES")
    found = J.resolve_capture_time(times, ["manual", "exif", "xmp", "iptc"], "fs")
    return found.select("file", J.show_time(F.col("when")).alias("shown"), F.col("when.offset_min").alias("offset_min"), "source", "is_capture_time")


def j1_resolve_capture_time_pairs(spark, sf_dir):
    """Original and digitised time as one source, the earlier of created and modified as the file's."""
    (times,) = views(spark, sf_dir, "V_TIMES")
    day = F.substring("fs", 1, 10)
    modified = F.when(F.col("file") % 4 == 1, F.concat(day, F.lit("T00:00"))).when(F.col("file") % 4 == 2, F.concat(day, F.lit(" 23:59:60")))
    found = J.resolve_capture_time(times.withColumn("modified", modified), ["manual", ("exif", ["exif", "xmp"])], ["fs", "modified"])
    return found.select("file", J.show_time(F.col("when")).alias("shown"), F.col("when.offset_min").alias("offset_min"), "source", "is_capture_time")


def j2_placement_extents(spark, sf_dir):
    return J.placement_extents(*views(spark, sf_dir, "V_IMAGES", "V_DRAWS"))


def j3_assemble_pages(spark, sf_dir):
    return J.assemble_pages(*views(spark, sf_dir, "V_PICKS", "V_PAGES"))


def j4_remap_references(spark, sf_dir):
    edges, picks = views(spark, sf_dir, "V_EDGES", "V_PICKS")
    named = picks.select("pick_no", F.concat(F.lit("c"), F.col("page").cast("string")).alias("target"))
    return J.remap_references(edges, named)


def j5_reachable_objects(spark, sf_dir):
    (edges,) = views(spark, sf_dir, "V_EDGES")
    roots = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    return J.reachable_objects(edges, roots, F.col("id") == "r3")


def j6_inherit_attributes(spark, sf_dir):
    return J.inherit_attributes(views(spark, sf_dir, "V_TREE")[0], ["a1", "a2"])


def j7_resolve_cascade(spark, sf_dir):
    """Orders as paragraphs: styles of parts, a table around some, indents that exclude each other."""
    (styles,) = views(spark, sf_dir, "V_STYLES")
    k = F.col("id")
    styles = styles.withColumns({"italic": F.when(k % 6 == 1, k % 4 == 1), "first_line": F.when(k % 7 == 2, k % 10), "hanging": F.when(k % 9 == 4, k % 12)})
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ord")).agg(F.min("l_partkey").alias("style"), F.max("l_partkey").alias("char_style"), F.min("l_linenumber").alias("n"), F.count("*").alias("m"))
    direct = {"d_size_half_pt": F.when(F.col("n") == 2, 99), "d_bold": F.when(F.col("n") == 3, True), "t_size_half_pt": F.when(F.col("m") > 3, 33), "t_font": F.when(F.col("m") > 5, "table"), "d_hanging": F.when(F.col("m") == 2, 7), "t_first_line": F.when(F.col("m") > 4, 5)}
    properties = ["size_half_pt", "bold", "italic", "font", "first_line", "hanging"]
    return J.resolve_cascade(items.withColumns(direct), styles, properties, ["bold", "italic"], {"size_half_pt": 21, "bold": False, "italic": False, "font": "base", "hanging": 0}, [("first_line", "hanging")])


def j8_ranked_lookup(spark, sf_dir):
    """Lists of preferred names hold every third name of the parts, among them some that the catalog lacks."""
    lookup, catalog = views(spark, sf_dir, "V_LOOKUP", "V_CATALOG")
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("place"))
    chains = parts.where("place % 3 = 1").select(F.when(F.col("place") % 2 == 0, "serif").otherwise("sans").alias("category"), "place", "name")
    return J.ranked_lookup(lookup, catalog.where("pref % 2 = 1"), chains)


def j9_chase_links(spark, sf_dir):
    (styles,) = views(spark, sf_dir, "V_STYLES")
    links = styles.select(F.col("id").cast("string").alias("id"), F.when(F.col("id") == 5, F.lit(None)).otherwise(F.col("based_on").cast("string")).alias("next"))
    return J.chase_links(links.select("id"), links)


def _sides(spark, sf_dir):
    (lines,) = views(spark, sf_dir, "V_LINES")
    return lines.where("side = 'ours'"), lines.where("side = 'ref'")


def j10_match_sequences(spark, sf_dir):
    """Matched lines of each document, and the largest offset of those on equal pages."""
    from ..functions.text import comparison_text

    place = {"x": F.col("line") % 7, "y": F.col("line") * 10 + F.col("height")}
    ours, ref = (s.withColumns(place | {"text": comparison_text(F.col("text"))}) for s in _sides(spark, sf_dir))
    matched = J.match_sequences(ours, ref).groupBy("doc").agg(F.count("*").alias("matched"), F.count_if("same_page").alias("same_page"), F.max("dy").alias("dy_max"))
    total = ref.where(F.length("text") >= 2).groupBy("doc").agg(F.count("*").alias("ref_lines"))
    return total.join(matched, "doc", "left").select("doc", "ref_lines", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("same_page", F.lit(0)).alias("same_page"), "dy_max")


def j11_boundary_drift(spark, sf_dir):
    """Both sides with the same text, paged every 8 and every 9 lines."""
    ours, ref = _sides(spark, sf_dir)
    same = ours.withColumn("page", F.floor(F.col("line") / 9).cast("int"))
    return J.boundary_drift(ours.where("text <> ''"), same.where("text <> ''"))


def j11_boundary_drift_unequal(spark, sf_dir):
    """The reference has a mark on every seventeenth line, so page starts are found by what follows them."""
    ours, ref = _sides(spark, sf_dir)
    return J.boundary_drift(ours.where("text <> ''"), ref.where("text <> ''"))


def j12_first_difference(spark, sf_dir):
    """Users as documents: a page for each type of event, ten events a line."""
    (frags,) = views(spark, sf_dir, "V_FRAGS")
    one = frags.select(F.col("page").alias("doc"), F.ascii("text").cast("long").alias("page"), F.floor(F.col("frag") / 10).alias("line"), "frag", "x", F.lit(10.0).alias("size"), F.lit("f").alias("font"), "text")
    k = F.col("frag")
    other = one.where("frag % 1009 <> 7").withColumns({"x": F.when(k % 53 == 3, F.col("x") + 1).otherwise(F.col("x")), "size": F.when(k % 47 == 5, 11.0).otherwise(10.0), "font": F.when(k % 43 == 6, "g").otherwise("f"), "text": F.when(k % 31 == 4, F.lit("other")).otherwise(F.col("text"))})
    rows = frags.count()
    lines = lambda df, step: J.dealt(df.select("doc", "page", "line", (F.col("line") * 2 + F.when(F.col("line") % 17 == step, 1).otherwise(0)).cast("double").alias("y")), rows, "doc", "page", "line").distinct()
    pages = lambda df, step: df.select("doc", "page", F.lit(100.0).alias("w"), (F.lit(200.0) + F.when((F.col("doc") + F.col("page")) % 19 == step, 1).otherwise(0)).alias("h")).distinct()
    side = lambda df, step: {"page": pages(df, step), "line": lines(df, step), "frag": df}
    return J.first_difference(side(one, -1), side(other, 3), 0.05)


def j13_regression_gate(spark, sf_dir):
    (metrics,) = views(spark, sf_dir, "V_METRICS")
    return J.regression_gate(metrics.where("run = 'cur'").drop("run"), metrics.where("run = 'base'").drop("run"))


def j14_mask_iou(spark, sf_dir):
    (masks,) = views(spark, sf_dir, "V_MASKS")
    a = masks.select(F.col("mask").alias("key"), "x", "y")
    b = masks.select((F.col("mask") - 1).alias("key"), "x", "y")
    keys = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"))
    return J.mask_iou(a, b, 7, 8, keys)


def j15_asof_next(spark, sf_dir):
    positions, stops = views(spark, sf_dir, "V_POS", "V_STOPS")
    return J.asof_next(positions, stops.where("layer = 'base'").select("grp", "pos"), 36.0)


def j15_asof_next_whole(spark, sf_dir):
    """All positions against all stops as one group, in stretches over all tasks."""
    positions, stops = views(spark, sf_dir, "V_POS", "V_STOPS")
    stops = stops.where("layer = 'base'").select(F.lit(0).alias("grp"), "pos").distinct()
    return J.asof_next(positions.select("id", F.lit(0).alias("grp"), "x"), stops, 36.0, 0).drop("grp")


def j16_merge_overrides(spark, sf_dir):
    (stops,) = views(spark, sf_dir, "V_STOPS")
    return J.merge_overrides(stops.where("layer = 'base'"), stops.where("layer = 'over'"), ["grp", "pos"])


def j17_resolve_relationships(spark, sf_dir):
    """Relations of the body and of a header: a reference sees those of its own part."""
    refs, rels = views(spark, sf_dir, "V_REFS", "V_RELS")
    part = lambda c: F.when(F.col(c) % 5 == 0, "header").otherwise("body")
    rels = rels.withColumn("part", F.explode(F.when(F.col("rel_id") % 3 == 0, F.array(F.lit("body"), F.lit("header"))).otherwise(F.array(part("rel_id")))))
    return J.resolve_relationships(refs.withColumn("part", part("ref")).withColumn("kind", F.when(F.col("kind") == "1-URGENT", "link").otherwise("picture")), rels)


def j18_coverage_split(spark, sf_dir):
    return J.coverage_split(*views(spark, sf_dir, "V_TEXT", "V_COVERAGE"))


QUERIES = {f.__name__: f for f in (j1_resolve_capture_time, j1_resolve_capture_time_pairs, j2_placement_extents, j3_assemble_pages, j4_remap_references, j5_reachable_objects, j6_inherit_attributes, j7_resolve_cascade, j8_ranked_lookup, j9_chase_links, j10_match_sequences, j11_boundary_drift, j11_boundary_drift_unequal, j12_first_difference, j13_regression_gate, j14_mask_iou, j15_asof_next, j15_asof_next_whole, j16_merge_overrides, j17_resolve_relationships, j18_coverage_split)}

#: Parsed times of V_TIMES: every text there is ISO 8601 of one of four shapes.
TIMES = """p AS (SELECT file, batch, ord, src, pri, s, left(s, 10) || ' ' || CASE WHEN length(s) = 10 THEN '00:00:00' WHEN length(s) = 17 THEN substr(s, 12, 5) || ':00' ELSE substr(s, 12, 8) END AS shown, CASE WHEN right(s, 1) = 'Z' THEN 0 WHEN length(s) = 25 THEN CAST(substr(s, 21, 2) AS INT) * 60 + CAST(substr(s, 24, 2) AS INT) END AS off FROM (SELECT file, batch, ord, 'manual' AS src, 1 AS pri, manual AS s FROM V_TIMES UNION ALL SELECT file, batch, ord, 'exif', 2, exif FROM V_TIMES UNION ALL SELECT file, batch, ord, 'xmp', 3, xmp FROM V_TIMES UNION ALL SELECT file, batch, ord, 'iptc', 4, iptc FROM V_TIMES UNION ALL SELECT file, batch, ord, 'fs', 5, fs FROM V_TIMES) WHERE s IS NOT NULL AND NOT starts_with(s, '0000')),
best AS (SELECT file, any_value(batch) AS batch, any_value(ord) AS ord, arg_min(src, pri) AS source, arg_min(shown, pri) AS shown, arg_min({'o': off}, pri).o AS offset_min FROM p GROUP BY file)"""

_UP = """up AS (SELECT id, id AS anc, 0 AS depth, [id] AS seen FROM t UNION ALL SELECT up.id, t.parent, depth + 1, list_append(seen, t.parent) FROM up JOIN t ON up.anc = t.id WHERE t.parent IS NOT NULL AND NOT list_contains(seen, t.parent) AND t.parent IN (SELECT id FROM t) AND depth < 64)"""

ORACLE_SQL = {
    "j1_resolve_capture_time": oracle(["V_TIMES"], TIMES + " SELECT file, shown, offset_min, source, source <> 'fs' AS is_capture_time FROM best"),
    "j1_resolve_capture_time_pairs": oracle(["V_TIMES"], """m AS (SELECT *, left(fs, 10) || ' ' || substr(fs, 12, 8) AS made, CASE WHEN file % 4 = 1 THEN left(fs, 10) || ' 00:00:00' WHEN file % 4 = 2 THEN left(fs, 10) || ' 23:59:60' END AS modified, exif IS NOT NULL AND NOT starts_with(exif, '0000') AS good FROM V_TIMES),
t AS (SELECT file, CASE WHEN manual IS NOT NULL THEN '2024-03-15 14:30:22' WHEN good THEN replace(exif, 'T', ' ') WHEN xmp IS NOT NULL THEN left(xmp, 10) || ' 12:34:00' ELSE least(made, coalesce(modified, made)) END AS shown, CAST(CASE WHEN manual IS NOT NULL THEN 480 WHEN good THEN NULL WHEN xmp IS NOT NULL THEN 0 END AS INT) AS offset_min, CASE WHEN manual IS NOT NULL THEN 'manual' WHEN good OR xmp IS NOT NULL THEN 'exif' ELSE 'file' END AS source FROM m) SELECT *, source <> 'file' AS is_capture_time FROM t"""),
    "j2_placement_extents": oracle(["V_IMAGES", "V_DRAWS"], "d AS (SELECT img, max(w_pt) AS w, max(h_pt) AS h FROM V_DRAWS GROUP BY img) SELECT i.img, coalesce(d.w, 595.0) AS w_pt, coalesce(d.h, 842.0) AS h_pt FROM V_IMAGES i LEFT JOIN d ON i.img = d.img"),
    "j3_assemble_pages": oracle(["V_PICKS", "V_PAGES"], """c AS (SELECT source, count(*) AS n FROM V_PAGES GROUP BY source), e AS (SELECT k.*, g.rotate AS own, CASE WHEN n IS NULL THEN 'unknown source' WHEN k.page < 0 OR k.page >= n THEN 'page out of range' WHEN k.rotate % 90 <> 0 THEN 'rotation not a multiple of 90' END AS error FROM V_PICKS k LEFT JOIN c ON k.source = c.source LEFT JOIN V_PAGES g ON k.source = g.source AND k.page = g.page) SELECT pick_no, source, page, CASE WHEN error IS NULL THEN ((own + rotate) % 360 + 360) % 360 END AS rotation, error FROM e"""),
    "j4_remap_references": oracle(["V_EDGES", "V_PICKS"], "f AS (SELECT 'c' || CAST(page AS VARCHAR) AS dst, min(pick_no) AS new_dst FROM V_PICKS GROUP BY 1) SELECT e.src, e.dst, f.new_dst FROM V_EDGES e LEFT JOIN f ON e.dst = f.dst"),
    "j5_reachable_objects": oracle(["V_EDGES"], """o AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id, row_number() OVER (ORDER BY 'o' || CAST(o_orderkey AS VARCHAR)) - 1 AS n FROM orders),
c AS (SELECT id, (SELECT count(*) FROM o) + row_number() OVER (ORDER BY m) - 1 AS n FROM (SELECT e.dst AS id, min(o.n) AS m FROM o JOIN V_EDGES e ON e.src = o.id GROUP BY e.dst)),
n AS (SELECT id, (SELECT count(*) FROM o) + (SELECT count(*) FROM c) + row_number() OVER (ORDER BY m) - 1 AS n FROM (SELECT e.dst AS id, min(c.n) AS m FROM c JOIN V_EDGES e ON e.src = c.id GROUP BY e.dst)),
r AS (SELECT id, (SELECT count(*) FROM o) + (SELECT count(*) FROM c) + (SELECT count(*) FROM n) + row_number() OVER (ORDER BY m) - 1 AS n FROM (SELECT e.dst AS id, min(n.n) AS m FROM n JOIN V_EDGES e ON e.src = n.id WHERE e.dst <> 'r3' GROUP BY e.dst))
SELECT id, CAST(0 AS INT) AS depth, n AS new_id FROM o UNION ALL SELECT id, 1, n FROM c UNION ALL SELECT id, 2, n FROM n UNION ALL SELECT id, 3, n FROM r"""),
    "j6_inherit_attributes": oracle(["V_TREE"], "t AS (SELECT * FROM V_TREE), " + _UP + " SELECT up.id, arg_min(t.a1, depth) AS a1, arg_min(t.a2, depth) AS a2 FROM up JOIN t ON up.anc = t.id GROUP BY up.id", True),
    "j7_resolve_cascade": oracle(["V_STYLES"], "t AS (SELECT id, based_on AS parent, size_half_pt, bold, CASE WHEN id % 6 = 1 THEN id % 4 = 1 END AS italic, font, CASE WHEN id % 7 = 2 THEN id % 10 END AS fl, CASE WHEN id % 9 = 4 THEN id % 12 END AS ha FROM V_STYLES), " + _UP + """, s AS (SELECT up.id, arg_min(size_half_pt, depth) AS size_half_pt, arg_min(bold, depth) AS bold, arg_min(italic, depth) AS italic, arg_min(font, depth) AS font, arg_min({'f': fl, 'h': ha}, depth) FILTER (fl IS NOT NULL OR ha IS NOT NULL) AS ind FROM up JOIN t ON up.anc = t.id GROUP BY up.id),
i AS (SELECT l_orderkey AS ord, min(l_partkey) AS style, max(l_partkey) AS char_style, min(l_linenumber) AS n, count(*) AS m FROM lineitem GROUP BY 1),
q AS (SELECT i.*, c.size_half_pt AS cs, p.size_half_pt AS ps, c.bold AS cb, p.bold AS pb, c.italic AS ci, p.italic AS pi, c.font AS cf, p.font AS pf, coalesce(CASE WHEN m = 2 THEN {'f': CAST(NULL AS BIGINT), 'h': CAST(7 AS BIGINT)} END, c.ind, p.ind, CASE WHEN m > 4 THEN {'f': CAST(5 AS BIGINT), 'h': CAST(NULL AS BIGINT)} END, {'f': CAST(NULL AS BIGINT), 'h': CAST(0 AS BIGINT)}) AS ind FROM i LEFT JOIN s p ON i.style = p.id LEFT JOIN s c ON i.char_style = c.id)
SELECT ord, CAST(coalesce(CASE WHEN n = 2 THEN 99 END, cs, ps, CASE WHEN m > 3 THEN 33 END, 21) AS INT) AS size_half_pt, coalesce(CASE WHEN n = 3 THEN true END, CASE WHEN cb IS NOT NULL AND pb IS NOT NULL THEN cb <> pb END, cb, pb, false) AS bold, coalesce(CASE WHEN ci IS NOT NULL AND pi IS NOT NULL THEN ci <> pi END, ci, pi, false) AS italic, coalesce(cf, pf, CASE WHEN m > 5 THEN 'table' END, 'base') AS font, CAST(ind.f AS DOUBLE) AS first_line, CAST(ind.h AS DOUBLE) AS hanging FROM q""", True),
    "j8_ranked_lookup": oracle(["V_LOOKUP", "V_CATALOG"], """c AS (SELECT * FROM V_CATALOG WHERE pref % 2 = 1), t AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'serif' ELSE 'sans' END AS category, p_partkey AS place, p_name AS name FROM part WHERE p_partkey % 3 = 1 AND p_name IN (SELECT name FROM c)), b AS (SELECT category, arg_min(name, place) AS name, min(place) AS place FROM t GROUP BY category), o AS (SELECT (SELECT arg_min(name, place) FROM t) AS listed, (SELECT arg_min(name, {'p': pref, 'n': name}) FROM c) AS any)
SELECT req, want, coalesce(e.name, s.name, b.name, o.listed, o.any) AS found, CASE WHEN e.name IS NOT NULL THEN 1 WHEN s.name IS NOT NULL THEN 2 WHEN b.name IS NOT NULL THEN 3 WHEN o.listed IS NOT NULL THEN 4 ELSE 5 END AS rank FROM V_LOOKUP l LEFT JOIN c e ON l.want = e.name LEFT JOIN c s ON regexp_replace(l.want, '[,-].*$', '') = s.name LEFT JOIN b ON l.category = b.category, o"""),
    "j9_chase_links": oracle(["V_STYLES"], """l AS (SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id = 5 THEN NULL ELSE CAST(based_on AS VARCHAR) END AS next FROM V_STYLES) SELECT a.id, CASE WHEN a.next IS NULL THEN a.id WHEN b.id IS NOT NULL AND b.next IS NULL THEN b.id WHEN c.id IS NOT NULL AND c.next IS NULL THEN c.id WHEN d.id IS NOT NULL AND d.next IS NULL THEN d.id END AS terminal FROM l a LEFT JOIN l b ON a.next = b.id LEFT JOIN l c ON b.next = c.id LEFT JOIN l d ON c.next = d.id"""),
    "j10_match_sequences": oracle(["V_LINES"], """n AS (SELECT side, doc, page, line, line * 10 + height AS y, regexp_replace(text, '[\\s\\x00-\\x1F\\x7F]+', '', 'g') AS t FROM V_LINES), a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line) - 1 AS k FROM n WHERE side = 'ours' AND length(t) >= 2), b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line) - 1 AS i FROM n WHERE side = 'ref' AND length(t) >= 2),
w AS (SELECT doc, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS at, CAST(NULL AS BIGINT) AS k FROM (SELECT DISTINCT doc FROM b) UNION ALL SELECT w.doc, b.i, coalesce(min(a.k) + 1, min(w.at)), min(a.k) FROM w JOIN b ON b.doc = w.doc AND b.i = w.i + 1 LEFT JOIN a ON a.doc = w.doc AND a.t = b.t AND a.k >= w.at AND a.k < w.at + 60 GROUP BY w.doc, b.i),
m AS (SELECT w.doc, count(*) AS matched, count(*) FILTER (a.page = b.page) AS same_page, CAST(max(abs(a.y - b.y)) FILTER (a.page = b.page) AS DOUBLE) AS dy_max FROM w JOIN a ON a.doc = w.doc AND a.k = w.k JOIN b ON b.doc = w.doc AND b.i = w.i GROUP BY w.doc), r AS (SELECT doc, count(*) AS ref_lines FROM b GROUP BY doc)
SELECT r.doc, ref_lines, coalesce(matched, 0) AS matched, coalesce(same_page, 0) AS same_page, dy_max FROM r LEFT JOIN m ON r.doc = m.doc""", True),
    "j11_boundary_drift": oracle(["V_LINES"], """o AS (SELECT doc, page, line, length(text) AS n, CAST(floor(line / 9) AS INT) AS rpage FROM V_LINES WHERE side = 'ours' AND text <> ''), f AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, sum(n) OVER (PARTITION BY doc) AS total FROM o), rs AS (SELECT doc, rpage, min(off) AS roff, any_value(total) AS total, dense_rank() OVER (PARTITION BY doc ORDER BY rpage) - 1 AS k FROM f GROUP BY doc, rpage), os AS (SELECT doc, page, min(off) AS ooff, dense_rank() OVER (PARTITION BY doc ORDER BY page) - 1 AS k FROM f GROUP BY doc, page),
x AS (SELECT rs.doc, rs.k, roff, coalesce(ooff, total) AS start FROM rs LEFT JOIN os ON rs.doc = os.doc AND rs.k = os.k WHERE rs.k > 0), b AS (SELECT x.doc, x.k, count(*) FILTER (f.off > least(roff, start) AND f.off <= greatest(roff, start)) AS bd FROM x JOIN f ON x.doc = f.doc GROUP BY x.doc, x.k)
SELECT doc, max(bd) AS bd_max, CAST(sum(bd) AS BIGINT) AS bd_sum, CAST(0 AS BIGINT) AS unmatched FROM b GROUP BY doc"""),
    "j11_boundary_drift_unequal": oracle(["V_LINES"], """t AS (SELECT side, doc, page, line, text, length(text) AS n FROM V_LINES WHERE text <> ''), f AS MATERIALIZED (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY side, doc ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM t), s AS (SELECT side, doc, string_agg(text, '' ORDER BY line) AS w, sum(n) AS total FROM t GROUP BY side, doc),
c AS (SELECT side, doc, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS ch FROM (SELECT side, doc, string_split(w, '') AS a FROM s)), g AS MATERIALIZED (SELECT side, doc, pos, """ + " || ".join(["ch", *(f"coalesce(lead(ch, {k}) OVER w, '')" for k in range(1, 12))]) + """ AS gram FROM c WINDOW w AS (PARTITION BY side, doc ORDER BY pos)),
p AS (SELECT side, doc, page, min(off) AS start, dense_rank() OVER (PARTITION BY side, doc ORDER BY page) - 1 AS k FROM f GROUP BY side, doc, page), e AS MATERIALIZED (SELECT o.doc, o.w = r.w AS same, o.total AS ta, r.total AS tb FROM s o JOIN s r ON o.doc = r.doc WHERE o.side = 'ours' AND r.side = 'ref'),
x AS MATERIALIZED (SELECT p.doc, p.k, p.start AS roff, e.same, e.ta, p.start * e.ta / CAST(e.tb AS DOUBLE) AS want, g.gram AS part FROM p JOIN e ON p.doc = e.doc JOIN g ON g.side = 'ref' AND g.doc = p.doc AND g.pos = p.start WHERE p.side = 'ref' AND p.k > 0),
y AS (SELECT x.doc, x.k, g.pos, abs(g.pos - want) AS far FROM x JOIN g ON g.side = 'ours' AND g.doc = x.doc AND g.gram = x.part WHERE length(x.part) = 12 UNION ALL SELECT x.doc, x.k, g.pos, abs(g.pos - want) FROM x JOIN g ON g.side = 'ours' AND g.doc = x.doc AND starts_with(g.gram, x.part) WHERE length(x.part) < 12),
z AS (SELECT doc, k, arg_min(pos, {'f': far, 'p': pos}) AS pos FROM y GROUP BY doc, k), q AS (SELECT x.doc, x.k, CASE WHEN same THEN roff ELSE z.pos END AS pos, coalesce(o.start, x.ta) AS start FROM x LEFT JOIN z ON x.doc = z.doc AND x.k = z.k LEFT JOIN p o ON o.side = 'ours' AND o.doc = x.doc AND o.k = x.k),
b AS (SELECT q.doc, q.k, count(*) FILTER (f.off > least(q.pos, q.start) AND f.off <= greatest(q.pos, q.start)) AS bd FROM q JOIN f ON f.side = 'ours' AND f.doc = q.doc WHERE q.pos IS NOT NULL GROUP BY q.doc, q.k)
SELECT q.doc, coalesce(max(bd), 0) AS bd_max, CAST(coalesce(sum(bd), 0) AS BIGINT) AS bd_sum, count(*) FILTER (q.pos IS NULL) AS unmatched FROM q LEFT JOIN b ON q.doc = b.doc AND q.k = b.k GROUP BY q.doc"""),
    "j12_first_difference": oracle(["V_FRAGS"], """a AS (SELECT page AS doc, ascii(text) AS page, CAST(floor(frag / 10) AS BIGINT) AS line, frag, x, 10 AS size, 'f' AS font, text FROM V_FRAGS), b AS (SELECT doc, page, line, frag, CASE WHEN frag % 53 = 3 THEN x + 1 ELSE x END AS x, CASE WHEN frag % 47 = 5 THEN 11 ELSE 10 END AS size, CASE WHEN frag % 43 = 6 THEN 'g' ELSE 'f' END AS font, CASE WHEN frag % 31 = 4 THEN 'other' ELSE text END AS text FROM a WHERE frag % 1009 <> 7),
d AS (SELECT coalesce(p.doc, q.doc) AS doc, -1 AS page, -1 AS line, -1 AS frag, 'page count' AS reason, 1 AS rank FROM (SELECT doc, count(DISTINCT page) AS n FROM a GROUP BY doc) p FULL JOIN (SELECT doc, count(DISTINCT page) AS n FROM b GROUP BY doc) q ON p.doc = q.doc WHERE p.n IS DISTINCT FROM q.n
UNION ALL SELECT p.doc, p.page, -1, -1, 'page size', 0 FROM (SELECT DISTINCT doc, page FROM a) p JOIN (SELECT DISTINCT doc, page FROM b) q ON p.doc = q.doc AND p.page = q.page WHERE (p.doc + p.page) % 19 = 3
UNION ALL SELECT coalesce(p.doc, q.doc), coalesce(p.page, q.page), -1, -1, 'line count', 1 FROM (SELECT doc, page, count(DISTINCT line) AS n FROM a GROUP BY doc, page) p FULL JOIN (SELECT doc, page, count(DISTINCT line) AS n FROM b GROUP BY doc, page) q ON p.doc = q.doc AND p.page = q.page WHERE p.n IS DISTINCT FROM q.n
UNION ALL SELECT p.doc, p.page, p.line, -1, 'baseline', 0 FROM (SELECT DISTINCT doc, page, line FROM a) p JOIN (SELECT DISTINCT doc, page, line FROM b) q ON p.doc = q.doc AND p.page = q.page AND p.line = q.line WHERE p.line % 17 = 3
UNION ALL SELECT coalesce(p.doc, q.doc), coalesce(p.page, q.page), coalesce(p.line, q.line), -1, 'frag count', 1 FROM (SELECT doc, page, line, count(*) AS n FROM a GROUP BY doc, page, line) p FULL JOIN (SELECT doc, page, line, count(*) AS n FROM b GROUP BY doc, page, line) q ON p.doc = q.doc AND p.page = q.page AND p.line = q.line WHERE p.n IS DISTINCT FROM q.n
UNION ALL SELECT a.doc, a.page, a.line, a.frag, CASE WHEN abs(a.x - b.x) > 0.05 THEN 'x' WHEN a.size <> b.size THEN 'size' WHEN a.font <> b.font THEN 'font' ELSE 'text' END, 0 FROM a JOIN b ON a.doc = b.doc AND a.page = b.page AND a.line = b.line AND a.frag = b.frag WHERE abs(a.x - b.x) > 0.05 OR a.size <> b.size OR a.font <> b.font OR a.text <> b.text),
m AS (SELECT doc, arg_min({'p': page, 'l': line, 'f': frag, 'r': reason}, {'p': page, 'l': line, 'f': frag, 'k': rank}) AS x FROM d GROUP BY doc)
SELECT doc, CASE WHEN x.p >= 0 THEN x.p END AS page, CASE WHEN x.l >= 0 THEN x.l END AS line, CASE WHEN x.f >= 0 THEN x.f END AS frag, x.r AS reason FROM m"""),
    "j13_regression_gate": oracle(["V_METRICS"], """j AS (SELECT c.*, b.hash AS bh, list_filter([CASE WHEN abs(c.pages - c.pages_ref) > abs(b.pages - b.pages_ref) THEN 'page gap' END, CASE WHEN c.bd_max > b.bd_max THEN 'drift max' END, CASE WHEN c.bd_sum > b.bd_sum THEN 'drift sum' END, CASE WHEN c.ly_median > b.ly_median + CAST(0.2 AS DOUBLE) THEN 'baseline median' END], lambda x: x IS NOT NULL) AS f, c.ri_mean < b.ri_mean - CAST(0.02 AS DOUBLE) AS hint FROM (SELECT * FROM V_METRICS WHERE run = 'cur') c LEFT JOIN (SELECT * FROM V_METRICS WHERE run = 'base') b ON c.doc_id = b.doc_id)
SELECT doc_id, CASE WHEN bh IS NULL THEN 'fail' WHEN hash <> bh THEN 'skip' WHEN len(f) > 0 THEN 'fail' WHEN hint THEN 'hint' ELSE 'pass' END AS verdict, CASE WHEN bh IS NULL THEN 'not in the baseline' WHEN hash <> bh THEN 'source changed' ELSE array_to_string(f, ', ') END AS reasons FROM j"""),
    "j14_mask_iou": oracle(["V_MASKS"], """a AS (SELECT mask AS key, x, y FROM V_MASKS WHERE x < 7), b AS (SELECT mask - 1 AS key, x, y FROM V_MASKS WHERE x < 7), c AS (SELECT coalesce(a.key, b.key) AS key, count(*) FILTER (a.key IS NOT NULL AND b.key IS NOT NULL) AS i, count(*) AS u FROM a FULL JOIN b ON a.key = b.key AND a.x = b.x AND a.y = b.y GROUP BY 1) SELECT vec_id AS key, round(coalesce(i / u, 1.0), 6) AS iou FROM embeddings LEFT JOIN c ON vec_id = key"""),
    "j15_asof_next": oracle(["V_POS", "V_STOPS"], """s AS (SELECT grp, CAST(pos AS DOUBLE) AS pos FROM V_STOPS WHERE layer = 'base'), m AS (SELECT p.id, min(s.pos) AS pos FROM V_POS p JOIN s ON s.grp = p.grp AND s.pos > p.x + CAST(0.001 AS DOUBLE) GROUP BY p.id) SELECT p.id, p.grp, p.x, round(coalesce(m.pos, (floor((p.x + CAST(0.001 AS DOUBLE)) / 36.0) + 1) * 36.0), 6) AS stop FROM V_POS p LEFT JOIN m ON p.id = m.id"""),
    "j15_asof_next_whole": oracle(["V_POS", "V_STOPS"], """s AS (SELECT DISTINCT CAST(pos AS DOUBLE) AS pos FROM V_STOPS WHERE layer = 'base'), p AS (SELECT id, x, x + CAST(0.001 AS DOUBLE) AS at FROM V_POS), m AS (SELECT p.id, s.pos FROM p ASOF LEFT JOIN s ON s.pos > p.at) SELECT p.id, p.x, round(coalesce(m.pos, (floor(p.at / 36.0) + 1) * 36.0), 6) AS stop FROM p JOIN m ON p.id = m.id"""),
    "j16_merge_overrides": oracle(["V_STOPS"], """o AS (SELECT * FROM V_STOPS WHERE layer = 'over') SELECT * FROM V_STOPS b WHERE layer = 'base' AND NOT EXISTS (SELECT 1 FROM o WHERE o.grp = b.grp AND o.pos = b.pos) UNION ALL SELECT * FROM o WHERE kind <> 'clear'"""),
    "j17_resolve_relationships": oracle(["V_REFS", "V_RELS"], """r AS (SELECT ref, rel_id, CASE WHEN ref % 5 = 0 THEN 'header' ELSE 'body' END AS part, CASE WHEN kind = '1-URGENT' THEN 'link' ELSE 'picture' END AS kind FROM V_REFS), x AS (SELECT *, CASE WHEN rel_id % 5 = 0 THEN 'header' ELSE 'body' END AS own FROM V_RELS) SELECT r.ref, r.kind, l.target FROM r LEFT JOIN x l ON r.rel_id = l.rel_id AND l.external = (r.kind = 'link') AND (l.rel_id % 3 = 0 OR l.own = r.part)"""),
    "j18_coverage_split": oracle(["V_CHARS", "V_COVERAGE"], r"""b AS (SELECT ch, min(dict) AS own FROM V_COVERAGE GROUP BY ch), r AS (SELECT c.doc_id, c.pos, b.own IS NULL AS missing, coalesce(b.own, 1) AS dict, regexp_matches(c.ch, '^[\x00-\x1F\x7F-\x9F]') AS control FROM V_CHARS c LEFT JOIN b ON c.ch = b.ch), l AS (SELECT *, lag(dict) OVER w AS pd, lag(missing) OVER w AS pm, lag(control) OVER w AS pc FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), g AS (SELECT *, sum(CASE WHEN pd IS NULL OR pd <> dict OR control OR pc OR pm <> missing THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l) SELECT doc_id, CAST(min(pos) AS INT) AS start, CAST(max(pos) + 1 AS INT) AS "end", min(dict) AS dict, bool_or(missing) AS missing FROM g GROUP BY doc_id, run"""),
}
