"""Adapter views: the driver tables in the input shapes of the operators, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name: (Spark SQL, DuckDB SQL). Later views use earlier ones.
VIEWS: dict[str, tuple[str, str]] = {
    # One row per web page as a file.
    "V_FILES": (
        r"""SELECT page_id AS ord, url AS path, regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) AS name, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)([?#].*)?$', 1)) AS ext, length(html) AS length FROM pages""",
        r"""SELECT page_id AS ord, url AS path, regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) AS name, lower(regexp_extract(url, '\.([A-Za-z0-9]+)([?#].*)?$', 1)) AS ext, length(html) AS length FROM pages""",
    ),
    # Hashes already converted (every third document).
    "V_DONE": (_same := r"""SELECT md5(text) AS hash FROM documents WHERE doc_id % 3 = 0""", _same),
    # Page-range requests incl. each error kind.
    "V_RANGES": (_same := r"""SELECT c_custkey AS req, CAST(1 + c_custkey % 12 AS INT) AS page_count, CASE CAST(c_custkey % 9 AS INT) WHEN 0 THEN '' WHEN 1 THEN '1-3,5' WHEN 2 THEN '4-' WHEN 3 THEN '-2' WHEN 4 THEN '5, 1-2, 2, 5' WHEN 5 THEN '1～3，5、7；8' WHEN 6 THEN '0' WHEN 7 THEN '3-1' ELSE 'a' END AS spec FROM customer""", _same),
    # Image inventory; document = customer.
    "V_IMAGES": (_same := r"""SELECT o_orderkey AS img, o_custkey AS doc, CAST(100 + (o_orderkey * 7919) % 4000 AS INT) AS w, CAST(100 + (o_orderkey * 104729) % 4000 AS INT) AS h, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'FlateDecode' WHEN 1 THEN 'JPXDecode' ELSE 'DCTDecode' END AS filter, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 8 END AS INT) AS bits, CAST(CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 3 END AS INT) AS components, o_orderkey % 13 = 0 AS has_smask, o_orderkey % 17 = 0 AS has_decode, 20000 + (o_orderkey * 31337) % 900000 AS stored_len, 20000 + (o_orderkey * 15485863) % 900000 AS jpeg_len, 20000 + (o_orderkey * 32452843) % 1800000 AS flate_est, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 72 WHEN 2 THEN 300 ELSE 96 END AS dpi FROM orders""", _same),
    # Draws of an image (several per image, some images none).
    "V_DRAWS": (_same := r"""SELECT l_orderkey AS img, l_extendedprice / 100 AS w_pt, l_quantity * 20 AS h_pt FROM lineitem""", _same),
    # Pages of source documents.
    "V_PAGES": (_same := r"""SELECT concat('s', CAST(p_size AS STRING)) AS source, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INT) AS page, CAST((p_partkey % 4) * 90 AS INT) AS rotate, 100 + (p_partkey * 7919) % 14300 AS w_pt, 100 + (p_partkey * 104729) % 14300 AS h_pt FROM part""", _same),
    # Ordered picks with bad ones mixed in; order keys count from 0 without gaps.
    "V_PICKS": (_same := r"""SELECT o_orderkey + 1 AS pick_no, concat('s', CAST(o_orderkey % 55 AS STRING)) AS source, CAST(o_custkey % 60 AS INT) AS page, CAST((o_orderkey % 9 - 4) * 45 AS INT) AS rotate FROM orders""", _same),
    # Three-level tree.
    "V_TREE": (_same := r"""SELECT concat('r', CAST(r_regionkey AS STRING)) AS id, CAST(NULL AS STRING) AS parent, r_name AS a1, CAST(NULL AS STRING) AS a2 FROM region UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), CASE WHEN n_nationkey % 3 = 0 THEN n_name END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END FROM nation UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)), CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END, NULL FROM customer""", _same),
    # Style chain with a branch of depth > 2 and a cycle at the top (style 1 and 2).
    "V_STYLES": (
        r"""SELECT p_partkey AS id, CASE WHEN p_partkey = 1 THEN 2 WHEN p_partkey = 2 THEN 1 WHEN p_partkey > 2 THEN p_partkey DIV 3 END AS based_on, CASE WHEN p_partkey % 4 = 0 THEN p_size END AS size_half_pt, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 = 0 END AS bold, CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS font FROM part""",
        r"""SELECT p_partkey AS id, CASE WHEN p_partkey = 1 THEN 2 WHEN p_partkey = 2 THEN 1 WHEN p_partkey > 2 THEN p_partkey // 3 END AS based_on, CASE WHEN p_partkey % 4 = 0 THEN p_size END AS size_half_pt, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 = 0 END AS bold, CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS font FROM part""",
    ),
    # Object graph (orders reference customers, customers nations, nations regions).
    "V_EDGES": (_same := r"""SELECT concat('o', CAST(o_orderkey AS STRING)) AS src, concat('c', CAST(o_custkey AS STRING)) AS dst FROM orders UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)) FROM customer UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)) FROM nation""", _same),
    # Paragraphs = document lines.
    "V_PARAS": (
        r"""SELECT doc_id, ord, text, CAST(length(text) % 3 AS INT) AS ilvl, CAST(1 + doc_id % 2 AS INT) AS num_id, CAST(ord % 4 AS INT) AS style, CAST(length(text) % 13 AS INT) AS space_before, CAST(length(text) % 7 AS INT) AS space_after, length(text) % 5 = 0 AS contextual FROM (SELECT doc_id, posexplode(split(text, '\n')) AS (ord, text) FROM documents)""",
        r"""SELECT doc_id, ord, text, CAST(length(text) % 3 AS INT) AS ilvl, CAST(1 + doc_id % 2 AS INT) AS num_id, CAST(ord % 4 AS INT) AS style, CAST(length(text) % 13 AS INT) AS space_before, CAST(length(text) % 7 AS INT) AS space_after, length(text) % 5 = 0 AS contextual FROM (SELECT doc_id, generate_subscripts(a, 1) - 1 AS ord, unnest(a) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))""",
    ),
    # Texts with digits and vowels turned into CJK, whole and as one row for each character.
    "V_TEXT": (_same := r"""SELECT doc_id, translate(text, 'aeo0123456789', '中文字〇一二三四五六七八九') AS text FROM documents""", _same),
    "V_CHARS": (
        r"""SELECT doc_id, posexplode(split(text, '')) AS (pos, ch) FROM V_TEXT WHERE length(text) > 0""",
        r"""SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS ch FROM (SELECT doc_id, string_split(text, '') AS a FROM V_TEXT WHERE length(text) > 0)""",
    ),
    # Space-separated tokens.
    "V_TOKENS": (
        r"""SELECT doc_id, posexplode(split(text, ' ')) AS (pos, tok) FROM documents""",
        r"""SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS tok FROM (SELECT doc_id, string_split(text, ' ') AS a FROM documents)""",
    ),
    # HTML tokens.
    "V_TAGS": (
        r"""SELECT page_id, posexplode(regexp_extract_all(html, '(<[^>]*>|[^<]+)', 1)) AS (pos, tok) FROM pages""",
        r"""SELECT page_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS tok FROM (SELECT page_id, regexp_extract_all(html, '(<[^>]*>|[^<]+)', 1) AS a FROM pages)""",
    ),
    # Conversations as documents, turns as sections; header references are sparse.
    "V_SECTIONS": (
        r"""SELECT conv_id AS doc, turn AS sec, CASE CAST((conv_id + turn) % 5 AS INT) WHEN 0 THEN 'continuous' WHEN 1 THEN 'odd' WHEN 2 THEN 'even' ELSE 'next' END AS start, CASE WHEN (conv_id + turn) % 4 = 0 THEN CAST(1 + turn AS INT) END AS restart, CASE WHEN turn % 3 = 0 THEN concat('d', CAST(turn AS STRING)) END AS hdr_default, CASE WHEN turn % 2 = 1 THEN concat('f', CAST(turn AS STRING)) END AS hdr_first, CAST(1 + length(text) DIV 200 AS INT) AS pages FROM conversations""",
        r"""SELECT conv_id AS doc, turn AS sec, CASE CAST((conv_id + turn) % 5 AS INT) WHEN 0 THEN 'continuous' WHEN 1 THEN 'odd' WHEN 2 THEN 'even' ELSE 'next' END AS start, CASE WHEN (conv_id + turn) % 4 = 0 THEN CAST(1 + turn AS INT) END AS restart, CASE WHEN turn % 3 = 0 THEN concat('d', CAST(turn AS STRING)) END AS hdr_default, CASE WHEN turn % 2 = 1 THEN concat('f', CAST(turn AS STRING)) END AS hdr_first, CAST(1 + length(text) // 200 AS INT) AS pages FROM conversations""",
    ),
    # Positioned fragments; page = user.
    "V_FRAGS": (_same := r"""SELECT user_id AS page, event_id AS frag, round(value, 1) AS y, CAST(event_id % 97 AS DOUBLE) AS x, event_type AS text FROM events""", _same),
    # Item results of a batch.
    "V_RESULTS": (_same := r"""SELECT event_type AS batch, event_id AS ord, concat('in', CAST(event_id AS STRING)) AS input, CASE WHEN event_id % 7 <> 0 THEN concat('out', CAST(event_id AS STRING)) END AS output, CASE WHEN event_id % 7 = 0 THEN concat('err', CAST(event_id % 3 AS STRING)) END AS error, 1000 + event_id % 5000 AS before, 500 + event_id % 6000 AS after FROM events""", _same),
    # Candidate times per file; each source sparse, some implausible.
    "V_TIMES": (_same := r"""SELECT event_id AS file, event_type AS batch, event_id AS ord, CASE WHEN event_id % 11 = 0 THEN '2024-03-15T14:30:22+08:00' END AS manual, CASE WHEN event_id % 3 = 0 THEN '0000-00-00T00:00:00' WHEN event_id % 3 = 1 THEN concat(substring(CAST(ts AS STRING), 1, 10), 'T', substring(CAST(ts AS STRING), 12, 8)) END AS exif, CASE WHEN event_id % 2 = 0 THEN concat(substring(CAST(ts AS STRING), 1, 10), 'T12:34Z') END AS xmp, CASE WHEN event_id % 5 = 0 THEN substring(CAST(ts AS STRING), 1, 10) END AS iptc, substring(CAST(ts AS STRING), 1, 19) AS fs FROM events""", _same),
    # 8 x 8 ink cells from the sign of each embedding dimension.
    "V_MASKS": (
        r"""SELECT vec_id AS mask, CAST(pos % 8 AS INT) AS x, CAST(pos DIV 8 AS INT) AS y FROM (SELECT vec_id, posexplode(embedding) AS (pos, v) FROM embeddings) WHERE v < 0""",
        r"""SELECT vec_id AS mask, CAST(pos % 8 AS INT) AS x, CAST(pos // 8 AS INT) AS y FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS v FROM embeddings) WHERE v < 0""",
    ),
    # Table cells: table = nation, five cells per row.
    "V_CELLS": (_same := r"""SELECT c_nationkey AS tbl, CAST(floor((n - 1) / 5) AS INT) AS r, CAST((n - 1) % 5 AS INT) AS c, CAST(1 + c_custkey % 3 AS INT) AS grid_span, CASE WHEN c_custkey % 4 = 0 THEN 'continue' END AS v_merge, CAST(c_custkey % 5 AS INT) AS thickness, c_custkey % 3 = 0 AS explicit, c_custkey AS color, c_mktsegment AS text FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer)""", _same),
    # List items = non-empty paragraphs; num 1 and 2 share abstract 1, num 2 overrides start at level 0.
    "V_ITEMS": (_same := r"""SELECT doc_id, ord, CAST(1 + ord % 2 AS INT) AS num_id, CAST(length(text) % 3 AS INT) AS ilvl, CAST(1 AS INT) AS abs FROM V_PARAS WHERE length(text) > 0""", _same),
    # Level definitions (broadcast).
    "V_LEVELS": (_same := r"""SELECT * FROM (VALUES (1, 0, 1, 'upperRoman', '%1.', NULL, false), (1, 1, 1, 'decimal', '%1.%2', NULL, false), (1, 2, 3, 'lowerLetter', '(%3)', 1, false)) AS t(abs, ilvl, start, fmt, lvl_text, restart, legal)""", _same),
    # Laid-out lines; ours breaks every 8 lines, the reference every 9.
    "V_LINES": (_same := r"""SELECT 'ours' AS side, doc_id AS doc, CAST(floor(ord / 8) AS INT) AS page, ord AS line, CAST(10 + length(text) % 40 AS INT) AS height, text FROM V_PARAS UNION ALL SELECT 'ref', doc_id, CAST(floor(ord / 9) AS INT), ord, CAST(10 + length(text) % 40 AS INT), CASE WHEN ord % 17 = 5 THEN concat(text, '!') ELSE text END FROM V_PARAS""", _same),
    # Per-document metrics, current (`cur`) and baseline (`base`).
    "V_METRICS": (_same := r"""SELECT 'base' AS run, doc_id, CASE WHEN doc_id % 19 = 0 THEN 'x' ELSE 'h' END AS hash, CAST(doc_id % 7 AS INT) AS pages, CAST(doc_id % 7 AS INT) AS pages_ref, CAST(doc_id % 5 AS INT) AS bd_max, CAST(doc_id % 9 AS INT) AS bd_sum, CAST(doc_id % 10 AS DOUBLE) / 10 AS ly_median, CAST(90 + doc_id % 10 AS DOUBLE) / 100 AS ri_mean FROM documents WHERE doc_id % 23 <> 0 UNION ALL SELECT 'cur', doc_id, 'h', CAST(doc_id % 8 AS INT), CAST(doc_id % 7 AS INT), CAST(doc_id % 6 AS INT), CAST(doc_id % 9 AS INT), CAST(doc_id % 13 AS DOUBLE) / 10, CAST(88 + doc_id % 11 AS DOUBLE) / 100 FROM documents""", _same),
    # Warnings.
    "V_WARN": (_same := r"""SELECT user_id AS item, event_type AS kind, props AS detail, event_id AS ord FROM events""", _same),
    # Text positions to be tabbed.
    "V_POS": (_same := r"""SELECT event_id AS id, user_id % 20 AS grp, round(value, 2) AS x FROM events""", _same),
    # Tab stops, base and override.
    "V_STOPS": (_same := r"""SELECT 'base' AS layer, p_size AS grp, p_partkey % 100 AS pos, 'left' AS kind FROM part WHERE p_partkey % 2 = 0 GROUP BY p_size, p_partkey % 100 UNION ALL SELECT 'over', p_size, p_partkey % 100, CASE WHEN p_size % 3 = 0 THEN 'clear' ELSE 'right' END FROM part WHERE p_partkey % 3 = 0 GROUP BY p_size, p_partkey % 100""", _same),
    # References (target id may be missing).
    "V_REFS": (_same := r"""SELECT o_orderkey AS ref, o_custkey + 100 AS rel_id, o_orderpriority AS kind FROM orders""", _same),
    # Relationships.
    "V_RELS": (_same := r"""SELECT c_custkey AS rel_id, c_name AS target, c_custkey % 4 = 0 AS external FROM customer""", _same),
    # Requests by name with a category.
    "V_LOOKUP": (_same := r"""SELECT p_partkey AS req, CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, ',x') ELSE p_name END AS want, CASE WHEN p_size > 25 THEN 'serif' ELSE 'sans' END AS category FROM part""", _same),
    # Available names with category preference.
    "V_CATALOG": (_same := r"""SELECT p_name AS name, min(p_partkey) AS pref, CASE WHEN min(p_partkey) % 2 = 0 THEN 'serif' ELSE 'sans' END AS category FROM part GROUP BY p_name""", _same),
    # Which dictionary covers which character (1 primary, 2 sibling, 3 fallback).
    "V_COVERAGE": (_same := r"""SELECT DISTINCT ch, CASE WHEN ch IN ('中', '文', '字') THEN 2 WHEN ch >= 'a' AND ch <= 'z' THEN 1 ELSE 3 END AS dict FROM V_CHARS WHERE ch <> '〇'""", _same),
    # Alternatives; a group is an order, options in line order, `last` is the fallback.
    "V_ALTS": (_same := r"""SELECT o_orderkey AS grp, n AS opt, CASE WHEN n = 3 THEN '' WHEN (o_orderkey + n) % 3 = 0 THEN 'wps' WHEN (o_orderkey + n) % 3 = 1 THEN 'wps w14' ELSE 'w16' END AS requires FROM orders CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3)) AS v(n)) AS k""", _same),
}


def _needed(names: list[str]) -> list[str]:
    """Views with those that they use, in order of definition."""
    todo, found = list(names), set()
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo += [v for v in VIEWS if v != name and v in VIEWS[name][0]]
    return [v for v in VIEWS if v in found]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views over the tables of ``sf_dir``."""
    wanted = _needed(list(names))
    text = " ".join(VIEWS[v][0] for v in wanted)
    for name in TABLES:
        if name in text:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name in wanted:
        spark.sql(VIEWS[name][0]).createOrReplaceTempView(name)
    return [spark.table(name) for name in names]


def oracle(names: list[str], body: str, recursive: bool = False) -> str:
    """DuckDB SQL: the named views as common table expressions before ``body``.

    ``body`` is a query, or further expressions ("x AS (...), y AS (...) SELECT ...").
    """
    own = [f"{v} AS ({VIEWS[v][1]})" for v in _needed(names)]
    start = "WITH RECURSIVE " if recursive else "WITH "
    if body.lstrip().upper().startswith("SELECT"):
        return (start + ", ".join(own) + " " if own else "") + body
    return start + ", ".join([*own, body])
