"""Queries over files, page ranges, images and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import oracle, table, views
from ..operators import project as P
from ..sources import files as S
from ..storage import shared_folder


def s1_scan_files(spark, sf_dir):
    found = S.scan_files(spark, sf_dir)
    return found.select("name", "depth", "length")


def s2_route_by_type(spark, sf_dir):
    (files,) = views(spark, sf_dir, "V_FILES")
    return S.route_by_type(files, S.routes(spark))


def s3_sniff_content(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("documents").alias("origin"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("content"), F.lit("pages").alias("origin"))
    rules = [("54686520", "the"), ("3C21444F4354595045", "html"), *S.SIGNATURES]
    return S.sniff_content(docs.unionByName(pages), "content", rules).groupBy("origin", "kind").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def s4_assign_output_names(spark, sf_dir):
    (files,) = views(spark, sf_dir, "V_FILES")
    requests = files.select("ord", F.concat(F.lit("d"), (F.col("ord") % 3).cast("string")).alias("dir"), F.concat(F.lit("page"), (F.col("length") % 5).cast("string")).alias("stem"), F.lit("pdf").alias("ext"))
    number = (F.col("ord") % 7).cast("string")
    taken = files.where("ord % 4 = 0").select(F.concat(F.lit("d"), (F.col("ord") % 3).cast("string")).alias("dir"), F.concat(F.lit("page"), (F.col("length") % 5).cast("string"), F.when(F.col("ord") % 7 < 2, "").otherwise(F.concat(F.lit(" ("), number, F.lit(")"))), F.lit(".pdf")).alias("name"))
    return S.assign_output_names(requests, taken)


def s5_write_guarded(spark, sf_dir):
    """Files written by a guarded write of the routed files, read back."""
    from uuid import uuid4

    (files,) = views(spark, sf_dir, "V_FILES")
    path = f"{shared_folder(spark)}/foliant/guarded-{uuid4().hex}"
    S.write_guarded(files.select("ord", "name", "ext"), path, [f"{sf_dir}/pages.parquet"])
    return spark.read.parquet(path)


def s6_split_every(spark, sf_dir):
    (picks,) = views(spark, sf_dir, "V_PICKS")
    return S.split_every(picks, 40, "bundle")


def s6_name_page_images(spark, sf_dir):
    """Customers as documents of up to 1,200 pages in fifty folders, some of which hold a first page already."""
    (ranges,) = views(spark, sf_dir, "V_RANGES")
    folder = lambda c: F.concat(F.lit("d"), c.cast("string"))
    requests = ranges.select("req", "spec", F.when(F.col("req") % 5 == 0, F.col("page_count") * 100).otherwise(F.col("page_count")).alias("page_count"), folder(F.col("req") % 50).alias("dir"), F.lit("scan").alias("stem"))
    occupied = requests.where("req % 50 % 3 = 0").select("dir", F.lit("scan_p001.png").alias("name")).distinct()
    return S.name_page_images(requests, occupied, "png")


def s7_incremental_pending(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.md5("text").alias("hash"))
    (done,) = views(spark, sf_dir, "V_DONE")
    return S.incremental_pending(docs, done)


def p1_gate_inputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    signed = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return P.gate_inputs(docs, F.col("lang") == "de", signed).select("doc_id", "accepted", "reason")


def p2_expand_page_ranges(spark, sf_dir):
    return P.expand_page_ranges(views(spark, sf_dir, "V_RANGES")[0])


def p3_plan_downscale(spark, sf_dir):
    return P.plan_downscale(views(spark, sf_dir, "V_IMAGES")[0], "balanced")


def measured_images(spark, sf_dir):
    """Images with their placements; some of another colour model, another filter, or without any measured candidate."""
    from ..operators.joins import placement_extents

    images, draws = views(spark, sf_dir, "V_IMAGES", "V_DRAWS")
    k = F.col("img")
    images = images.withColumns({"components": F.when(k % 19 == 3, 2).otherwise(F.col("components")), "filter": F.when(k % 23 == 4, "CCITTFaxDecode").otherwise(F.col("filter")), **{c: F.when(k % 29 != 5, F.col(c)) for c in ("jpeg_len", "flate_est")}})
    return images.join(placement_extents(images, draws), "img")


def p4_decide_recompression(spark, sf_dir):
    return P.decide_recompression(measured_images(spark, sf_dir), "balanced").select("img", "decision", "chosen_len")


def p5_decide_fidelity(spark, sf_dir):
    return P.decide_fidelity(views(spark, sf_dir, "V_IMAGES")[0], "high")


def o1_natural_sort(spark, sf_dir):
    (files,) = views(spark, sf_dir, "V_FILES")
    return P.natural_sort(files.select("ord", "name"), "name", "ord")


def o3_top_n_with_more(spark, sf_dir):
    (files,) = views(spark, sf_dir, "V_FILES")
    return P.top_n_with_more(files.select("ord", "name", "ext"), "ext", "ord", 3)


def u1_append_distinct(spark, sf_dir):
    (files,) = views(spark, sf_dir, "V_FILES")
    rows = files.select("ord", (F.col("length") % 97).alias("item"))
    kept, rejected = P.append_distinct(rows.where("ord < 20"), rows.where("ord >= 20"), "item", "ord", F.col("item") % 3 != 0)
    return kept.withColumn("rejected", F.lit(rejected.first()[0]))


def u2_reindex_sources(spark, sf_dir):
    return P.reindex_sources(views(spark, sf_dir, "V_PICKS")[0]).select("pick_no", "source", "new_source")


def u3_dilate(spark, sf_dir):
    return P.dilate(views(spark, sf_dir, "V_MASKS")[0], 8, 8)


QUERIES = {f.__name__: f for f in (s1_scan_files, s2_route_by_type, s3_sniff_content, s4_assign_output_names, s5_write_guarded, s6_split_every, s6_name_page_images, s7_incremental_pending, p1_gate_inputs, p2_expand_page_ranges, p3_plan_downscale, p4_decide_recompression, p5_decide_fidelity, o1_natural_sort, o3_top_n_with_more, u1_append_distinct, u2_reindex_sources, u3_dilate)}

_ROUTES = " ".join("WHEN ext IN (" + ", ".join(f"'{e}'" for e in own) + f") THEN '{r}'" for r, own in S.ROUTES.items())
_PAGE = """CASE WHEN dpi IS NOT NULL AND abs(dpi - 72.0) >= 0.5 AND abs(dpi - 96.0) >= 0.5 THEN CAST(72.0 AS DOUBLE) / dpi ELSE CAST(841.89 AS DOUBLE) / greatest(w, h) END"""
_SIZED = f"""sz AS (SELECT *, greatest(w * s / o, CAST(1 AS DOUBLE)) AS page_w, greatest(h * s / o, CAST(1 AS DOUBLE)) AS page_h FROM (SELECT *, greatest(w * s / CAST(14400 AS DOUBLE), h * s / CAST(14400 AS DOUBLE), CAST(1 AS DOUBLE)) AS o FROM (SELECT *, {_PAGE} AS s FROM V_IMAGES)))"""

_IMAGES = """c AS (SELECT req, CASE WHEN req % 5 = 0 THEN page_count * 100 ELSE page_count END AS n, CAST(req % 9 AS INT) AS k FROM V_RANGES), x AS (SELECT req, n, CASE k WHEN 0 THEN range(1, n + 1) WHEN 1 THEN [1, 2, 3, 5] WHEN 2 THEN range(4, n + 1) WHEN 3 THEN [1, 2] WHEN 4 THEN [5, 1, 2] ELSE [1, 2, 3, 5, 7, 8] END AS l FROM c WHERE k <= 5 AND n >= list_extract([1, 5, 4, 2, 5, 8], k + 1)),
p AS (SELECT req, n, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS page FROM x), s AS (SELECT *, 'd' || req % 50 AS dir, 'scan_p' || lpad(CAST(page AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0') AS stem FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY req, pos) + CASE WHEN stem = 'scan_p001' AND req % 50 % 3 = 0 THEN 1 ELSE 0 END AS i FROM s)
SELECT req, CAST(pos AS INT) AS pos, CAST(page AS BIGINT) AS page, dir, stem || CASE WHEN i = 1 THEN '' ELSE ' (' || i || ')' END || '.png' AS output FROM r"""

ORACLE_SQL = {
    "s2_route_by_type": oracle(["V_FILES"], f"""r AS (SELECT *, CASE {_ROUTES} ELSE 'other' END AS route FROM V_FILES), n AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY ord) AS rn FROM r)
SELECT route, count(*) AS n, string_agg(name, ', ' ORDER BY ord) FILTER (rn <= 3) || CASE WHEN count(*) > 3 THEN ' …' ELSE '' END AS notice FROM n GROUP BY route"""),
    "s3_sniff_content": """WITH c AS (SELECT doc_id AS id, text AS content, 'documents' AS origin FROM documents UNION ALL SELECT page_id, html, 'pages' FROM pages), k AS (SELECT *, CASE WHEN starts_with(content, 'The ') THEN 'the' WHEN starts_with(content, '<!DOCTYPE') THEN 'html' WHEN starts_with(content, 'II*' || chr(0)) OR starts_with(content, 'MM' || chr(0) || '*') THEN 'tiff' ELSE 'other' END AS kind FROM c) SELECT origin, kind, count(*) AS n, min(id) AS first_id FROM k GROUP BY origin, kind""",
    "s4_assign_output_names": oracle(["V_FILES"], """f AS (SELECT ord, 'd' || CAST(ord % 3 AS VARCHAR) AS dir, 'page' || CAST(length % 5 AS VARCHAR) AS stem FROM V_FILES), t AS (SELECT DISTINCT dir, stem, CASE WHEN ord % 7 < 2 THEN 1 ELSE ord % 7 END AS n FROM f WHERE ord % 4 = 0), g AS (SELECT *, n - row_number() OVER (PARTITION BY dir, stem ORDER BY n) AS free FROM t), q AS (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY ord) AS r FROM f), p AS (SELECT ord, dir, stem, r + (SELECT count(*) FROM g WHERE g.dir = q.dir AND g.stem = q.stem AND g.free < q.r) AS n FROM q)
SELECT ord, dir, stem || CASE WHEN n = 1 THEN '' ELSE ' (' || CAST(n AS VARCHAR) || ')' END || '.pdf' AS output FROM p"""),
    "s5_write_guarded": oracle(["V_FILES"], "SELECT ord, name, ext FROM V_FILES"),
    "s6_split_every": oracle(["V_PICKS"], """SELECT CAST(floor((pick_no - 1) / 40) AS BIGINT) AS part, 'bundle_p' || CASE WHEN min(pick_no) = max(pick_no) THEN CAST(min(pick_no) AS VARCHAR) ELSE CAST(min(pick_no) AS VARCHAR) || '-' || CAST(max(pick_no) AS VARCHAR) END AS name, min(pick_no) AS first, max(pick_no) AS last, count(*) AS pages FROM V_PICKS GROUP BY 1"""),
    "s6_name_page_images": oracle(["V_RANGES"], _IMAGES),
    "s7_incremental_pending": oracle(["V_DONE"], """d AS (SELECT doc_id AS ord, md5(text) AS hash FROM documents) SELECT ord, hash, CASE WHEN hash IN (SELECT hash FROM V_DONE) THEN 'done' WHEN ord = min(ord) OVER (PARTITION BY hash) THEN 'convert' ELSE 'reuse' END AS state FROM d"""),
    "p1_gate_inputs": """SELECT doc_id, reason IS NULL AS accepted, reason FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN 'encrypted' WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'signed' END AS reason FROM documents)""",
    "p2_expand_page_ranges": oracle(["V_RANGES"], """c AS (SELECT req, page_count, CAST(req % 9 AS INT) AS k FROM V_RANGES),
x AS (SELECT req, page_count, list_distinct_ordered FROM (SELECT req, page_count, CASE k WHEN 0 THEN range(1, page_count + 1) WHEN 1 THEN [1, 2, 3, 5] WHEN 2 THEN range(4, page_count + 1) WHEN 3 THEN [1, 2] WHEN 4 THEN [5, 1, 2] WHEN 5 THEN [1, 2, 3, 5, 7, 8] ELSE CAST([] AS BIGINT[]) END AS list_distinct_ordered FROM c)),
e AS (SELECT req, CASE WHEN k = 6 THEN 'pages count from 1' WHEN k = 7 THEN 'first page after last: 3-1' WHEN k = 8 THEN 'not a page number: a' WHEN k = 1 AND page_count < 3 THEN 'no page 3 of ' || page_count WHEN k = 1 AND page_count < 5 THEN 'no page 5 of ' || page_count WHEN k = 2 AND page_count < 4 THEN 'no page 4 of ' || page_count WHEN k = 3 AND page_count < 2 THEN 'no page 2 of ' || page_count WHEN k = 4 AND page_count < 5 THEN 'no page 5 of ' || page_count WHEN k = 5 AND page_count < 3 THEN 'no page 3 of ' || page_count WHEN k = 5 AND page_count < 5 THEN 'no page 5 of ' || page_count WHEN k = 5 AND page_count < 7 THEN 'no page 7 of ' || page_count WHEN k = 5 AND page_count < 8 THEN 'no page 8 of ' || page_count END AS error FROM c)
SELECT req, CAST(pos AS INT) AS pos, CAST(page AS BIGINT) AS page, CAST(NULL AS VARCHAR) AS error FROM (SELECT x.req, generate_subscripts(list_distinct_ordered, 1) - 1 AS pos, unnest(list_distinct_ordered) AS page FROM x JOIN e ON x.req = e.req WHERE e.error IS NULL) UNION ALL SELECT req, NULL, NULL, error FROM e WHERE error IS NOT NULL"""),
    "p3_plan_downscale": oracle(["V_IMAGES"], _SIZED + """, cur AS (SELECT *, greatest(w / (page_w / 72.0), h / (page_h / 72.0)) AS c FROM sz), t AS (SELECT *, greatest(CAST(round(w * (200.0 / c)) AS INT), 1) AS tw, greatest(CAST(round(h * (200.0 / c)) AS INT), 1) AS th FROM cur)
SELECT img, round(page_w, 6) AS page_w, round(page_h, 6) AS page_h, round(c, 6) AS dpi, CASE WHEN c > CAST(200.0 AS DOUBLE) * 1.02 AND (tw < w OR th < h) THEN tw END AS target_w, CASE WHEN c > CAST(200.0 AS DOUBLE) * 1.02 AND (tw < w OR th < h) THEN th END AS target_h FROM t"""),
    "p4_decide_recompression": oracle(["V_IMAGES", "V_DRAWS"], """d AS (SELECT img, max(w_pt) AS w_pt, max(h_pt) AS h_pt FROM V_DRAWS GROUP BY img), i AS (SELECT img, w, h, bits, has_smask, stored_len, CASE WHEN img % 19 = 3 THEN 2 ELSE components END AS components, CASE WHEN img % 23 = 4 THEN 'CCITTFaxDecode' ELSE filter END AS filter, CASE WHEN img % 29 <> 5 THEN jpeg_len END AS jpeg_len, CASE WHEN img % 29 <> 5 THEN flate_est END AS flate_est, coalesce(w_pt, 595.0) AS w_pt, coalesce(h_pt, 842.0) AS h_pt FROM V_IMAGES LEFT JOIN d USING (img)), c AS (SELECT *, greatest(w / (w_pt / 72.0), h / (h_pt / 72.0)) AS cur, CASE WHEN filter <> 'DCTDecode' AND flate_est <= jpeg_len * 1.5 THEN flate_est ELSE jpeg_len END AS cand FROM i),
x AS (SELECT *, CASE WHEN bits <> 8 THEN 'skip:mask' WHEN has_smask THEN 'skip:transparency' WHEN filter = 'JPXDecode' THEN 'skip:jpeg2000' WHEN w < 200 OR h < 200 THEN 'tiny' WHEN components = 4 THEN 'skip:cmyk' WHEN components NOT IN (1, 3) THEN 'skip:special' WHEN filter NOT IN ('DCTDecode', 'FlateDecode', 'JPXDecode') THEN 'skip:other' WHEN jpeg_len IS NULL AND flate_est IS NULL THEN 'skip:undecodable' WHEN filter = 'DCTDecode' AND NOT (cur > CAST(200.0 AS DOUBLE) * 1.02) THEN 'optimal' WHEN cand < stored_len THEN 'replace' ELSE 'kept' END AS decision FROM c)
SELECT img, decision, CASE WHEN decision = 'replace' THEN cand ELSE stored_len END AS chosen_len FROM x"""),
    "p5_decide_fidelity": oracle(["V_IMAGES"], _SIZED + """, c AS (SELECT *, greatest(w / (page_w / 72.0), h / (page_h / 72.0)) > CAST(300.0 AS DOUBLE) * 1.02 AS shrink, filter = 'DCTDecode' AND bits = 8 AND components IN (1, 3) AS ok, flate_est <= jpeg_len * 1.5 AS fl FROM sz)
SELECT img, doc, CASE WHEN ok AND NOT shrink THEN 'passthrough' WHEN ok AND (CASE WHEN fl THEN flate_est ELSE jpeg_len END) >= stored_len THEN 'passthrough' WHEN fl THEN 'lossless' ELSE 'reencoded' END AS fidelity FROM c"""),
    "o1_natural_sort": oracle(["V_FILES"], """k AS (SELECT ord, name, ext, list_transform(regexp_extract_all(name, '([0-9]+|[^0-9]+)', 1), lambda c: CASE WHEN regexp_matches(c, '^[0-9]') THEN {'kind': 1, 'text': '', 'num': CAST(c AS HUGEINT)} ELSE {'kind': 0, 'text': lower(c), 'num': CAST(0 AS HUGEINT)} END) AS key FROM V_FILES) SELECT ord, name, row_number() OVER (ORDER BY key, ord) AS place FROM k"""),
    "o3_top_n_with_more": oracle(["V_FILES"], """SELECT ord, name, ext, CAST(rank AS INT) AS rank, more FROM (SELECT ord, name, ext, row_number() OVER (PARTITION BY ext ORDER BY ord) AS rank, count(*) OVER (PARTITION BY ext) > 3 AS more FROM V_FILES) WHERE rank <= 3"""),
    "u1_append_distinct": oracle(["V_FILES"], """r AS (SELECT ord, length % 97 AS item, CASE WHEN ord < 20 THEN 0 ELSE 1 END AS batch FROM V_FILES), k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY batch, ord) AS n FROM r WHERE batch = 0 OR item % 3 <> 0) SELECT ord, item, batch, (SELECT count(*) FROM r WHERE batch = 1 AND item % 3 = 0) AS rejected FROM k WHERE n = 1"""),
    "u2_reindex_sources": oracle(["V_PICKS"], """SELECT pick_no, source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INT) AS new_source FROM V_PICKS"""),
    "u3_dilate": oracle(["V_MASKS"], """SELECT DISTINCT mask, x + dx AS x, y + dy AS y FROM V_MASKS, (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy) WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7"""),
}
