"""Joins: provenance, placements, page assembly, hierarchies, fallbacks, comparisons."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.characters import CODE_POINTS, characters, stretches
from ..functions.folds import walk
from ..functions.text import let
from ..storage import fresh_path, met, stored
from . import masks
from .project import number_rows
from .scan import Ordered

_ISO = r"^\s*(\d{4})-(\d{2})-(\d{2})(?:[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:[.,]\d*)?)?(Z|z|[+-]\d{2}(?::?\d{2})?)?)?\s*$"


def parse_iso8601(text: Column) -> Column:
    """Struct of year, month, day, hour, minute, second, offset_min; null if unreadable or implausible.

    Date alone means midnight; fractions of seconds are dropped; the offset stays null where none is
    written. Day 31 of any month and second 60 are plausible, so fields are kept as written.
    """
    # One match: the text becomes its parts, or stays what it is.
    cut = F.split(F.regexp_replace(text, _ISO, "".join(f"\x01${i}" for i in range(1, 8))), "\x01")
    names = ("year", "month", "day", "hour", "minute", "second")

    def fields(p: Column) -> Column:
        zone, digits = p[7], F.translate(p[7], "+-:", "")
        minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
        offset = F.when(zone == "", F.lit(None).cast("int")).when(F.lower(zone) == "z", 0).when(zone.startswith("-"), -minutes).otherwise(minutes)
        return F.struct(*(F.coalesce(p[i].try_cast("int"), F.lit(0)).alias(n) for i, n in enumerate(names, 1)), offset.alias("offset_min"))

    def plausible(t: Column) -> Column:
        inside = t["year"].between(1000, 9999) & t["month"].between(1, 12) & t["day"].between(1, 31) & (t["hour"] <= 23) & (t["minute"] <= 59) & (t["second"] <= 60)
        return F.when(inside & F.coalesce(F.abs(t["offset_min"]) <= 840, F.lit(True)), t)

    read = let(cut, lambda p: F.when(F.size(p) == 8, let(fields(p), plausible)))
    # A text that holds the mark itself is no time.
    return F.when(~F.contains(text, F.lit("\x01")), read)


def show_time(when: Column) -> Column:
    return F.when(when.isNotNull(), F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *(when[n] for n in ("year", "month", "day", "hour", "minute", "second"))))


def resolve_capture_time(files: DataFrame, sources: list[str | tuple[str, list[str]]], file_time: str | list[str]) -> DataFrame:
    """``files`` with when (struct), source, is_capture_time: the first plausible source wins.

    ``sources`` are text columns in the order of trust, or pairs of a source's name and its columns
    (the original and the digitised time of one header, say), of which the first plausible counts. ``file_time`` comes last and is never
    a capture time; of several columns (created, modified) the earliest counts. Each text is parsed
    once.
    """
    named = [(s, [s]) if isinstance(s, str) else s for s in sources]
    times = [file_time] if isinstance(file_time, str) else list(file_time)
    last = times[0] if len(times) == 1 else "file"
    columns = list(dict.fromkeys([c for _, own in named for c in own] + times))
    place = {c: i for i, c in enumerate(columns)}

    def first(t: Column) -> Column:
        earliest = F.array_min(F.array_compact(F.array(*(t[place[c]] for c in times)))) if len(times) > 1 else t[place[times[0]]]
        order = [(n, F.coalesce(*(t[place[c]] for c in own))) for n, own in named] + [(last, earliest)]
        return F.coalesce(*(F.when(x.isNotNull(), F.struct(x.alias("when"), F.lit(n).alias("source"))) for n, x in order))

    out = files.withColumn("_found", let(F.array(*(parse_iso8601(F.col(c)) for c in columns)), first))
    out = out.withColumn("when", F.col("_found.when")).withColumn("source", F.col("_found.source"))
    return out.withColumn("is_capture_time", F.col("source").isNotNull() & (F.col("source") != last)).drop("_found")


def placement_extents(images: DataFrame, draws: DataFrame) -> DataFrame:
    """img, w_pt, h_pt: largest width and height over all draws, each on its own; else a full page."""
    most = draws.groupBy("img").agg(F.max("w_pt").alias("w"), F.max("h_pt").alias("h"))
    return images.select("img").join(most, "img", "left").select("img", F.coalesce("w", F.lit(595.0)).alias("w_pt"), F.coalesce("h", F.lit(842.0)).alias("h_pt"))


def assemble_pages(picks: DataFrame, pages: DataFrame) -> DataFrame:
    """pick_no, source, page, rotation, error: output page i is pick i; bad picks say why.

    Without any pick there is one row, whose error says so.
    """
    counts = pages.groupBy("source").agg(F.count("*").alias("count"))
    own = pages.select("source", "page", F.col("rotate").alias("own"))
    joined = picks.join(counts, "source", "left").join(own, ["source", "page"], "left")
    error = F.when(F.col("count").isNull(), "unknown source").when((F.col("page") < 0) | (F.col("page") >= F.col("count")), "page out of range").when(F.col("rotate") % 90 != 0, "rotation not a multiple of 90")
    pages_made = joined.withColumn("error", error).select("pick_no", "source", "page", F.when(F.col("error").isNull(), F.pmod(F.coalesce("own", F.lit(0)) + F.col("rotate"), F.lit(360))).alias("rotation"), "error")
    none = picks.sparkSession.range(1).join(picks.select(F.lit(True).alias("_some")).limit(1), F.lit(True), "left_anti")
    no_picks = none.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in pages_made.schema.fields[:-1]), F.lit("no picks").alias("error"))
    return pages_made.unionByName(no_picks)


def remap_references(edges: DataFrame, picks: DataFrame) -> DataFrame:
    """``edges`` (src, dst) with new_dst: the first pick of the target, null where it is not picked."""
    first = picks.groupBy(F.col("target").alias("dst")).agg(F.min("pick_no").alias("new_dst"))
    return edges.join(first, "dst", "left").select("src", "dst", "new_dst")


#: Objects of a level up to which it is broadcast to the edges, and up to which objects are numbered in one task.
SMALL_LEVEL, ONE_TASK = 100_000, 1_000_000
#: Edges, and objects met, from which on a small level reads only its own buckets of them; the number of buckets.
LARGE_SET, BUCKETS = 1_000_000, 1024


def reachable_objects(edges: DataFrame, roots: DataFrame, stop: Column) -> DataFrame:
    """id, depth, new_id: what can be reached from ``roots`` (id) over ``edges`` (src, dst), breadth first.

    Targets for which ``stop`` (over a column id) holds are not entered. ``new_id`` counts from 0
    without gaps in the order of discovery: roots by ``ord`` where they have one, else by id; then by
    the new id of the object that leads there, and by ``ord`` of the edge, else by target. Null ids and
    targets are no objects; there is no limit of depth, and a cycle ends where all its objects are met.

    The set of objects met only grows: each level is written once, in a folder of its own, sorted by
    buckets of its ids, and never again. Edges are written once, sorted alike. A small level is
    broadcast to them and, where they are many, reads the buckets of its own ids only; once very many
    objects have been met, its targets are looked up in their own buckets too. One range sort at the end numbers all levels (one task, where they are few).
    """
    spark = edges.sparkSession
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    order = lambda df, other: (F.col("ord") if "ord" in df.columns else F.col(other)).alias("place")
    links = edges.where("src is not null and dst is not null").select("src", "dst", order(edges, "dst"), bucket("src").alias("bucket"))
    links = stored(links.sortWithinPartitions("bucket"), "edges")
    kind, many = links.schema["place"].dataType, links.count() > LARGE_SET
    folder = fresh_path(spark, "reached")

    def keep(level: DataFrame, depth: int) -> int:
        """Write a level (id, by) once; how many objects it has."""
        level.select("id", "by", bucket("id").alias("bucket")).sortWithinPartitions("bucket").write.parquet(f"{folder}/depth={depth}")
        return spark.read.parquet(f"{folder}/depth={depth}").count()

    def numbered(df: DataFrame, keys: list[str], n: int) -> DataFrame:
        """``df`` (id and keys) with n, from 0 in their order."""
        if n <= ONE_TASK:
            return df.withColumn("n", (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))
        return number_rows(df, [F.col(k) for k in keys], "n").withColumn("n", F.col("n") - 1)

    first = stored(roots.where("id is not null").select("id", order(roots, "id")).groupBy("id").agg(F.min("place").alias("place")), "roots")
    first = numbered(first, ["place", "id"], first.count())
    depth, known = 0, 0
    n = keep(first.select("id", F.struct(F.col("n").alias("parent"), F.lit(None).cast(kind).alias("place")).alias("by")), 0)
    levels = spark.read.parquet(f"{folder}/depth=0").schema
    read = lambda *depths: spark.read.schema(levels).parquet(*(f"{folder}/depth={d}" for d in depths))
    buckets = lambda df, c: [r[0] for r in df.select(bucket(c)).distinct().collect()]  # noqa: E731  at most BUCKETS numbers
    while n:
        level = read(depth)
        frontier = numbered(level.select("id", "by"), ["by", "id"], n).select("id", (F.col("n") + known).alias("parent"))
        reached = links
        if n <= SMALL_LEVEL:
            frontier = F.broadcast(frontier)
            if many and n <= BUCKETS:
                reached = links.where(F.col("bucket").isin(buckets(level, "id")))
        known += n
        step = reached.join(frontier, frontier["id"] == reached["src"]).select(F.col("dst").alias("id"), F.struct("parent", "place").alias("by"))
        step = step.where(~F.coalesce(stop, F.lit(False))).groupBy("id").agg(F.min("by").alias("by"))
        met = read(*range(depth + 1))
        if known > LARGE_SET and n <= SMALL_LEVEL:
            step = stored(step, "candidates")
            some = step.limit(BUCKETS + 1).count()
            if some <= BUCKETS:
                met = met.where(F.col("bucket").isin(buckets(step, "id")))
        depth += 1
        n = keep(step.join(met.select("id"), "id", "left_anti"), depth)
    every = spark.read.option("basePath", folder).parquet(*(f"{folder}/depth={d}" for d in range(max(depth, 1))))
    every = every.select("id", F.col("depth").cast("int").alias("depth"), "by")
    return numbered(every, ["depth", "by", "id"], known).select("id", "depth", F.col("n").alias("new_id"))


def _dealt(key: Column, other: Column) -> Column:
    """Second key of a left join by ``key``: 0, but rows without a key, which find nothing, are dealt over the tasks."""
    return F.when(key.isNull(), F.pmod(F.xxhash64(other), F.lit(BUCKETS).cast("long"))).otherwise(F.lit(0).cast("long"))


def inherit_attributes(nodes: DataFrame, attributes: list[str], max_depth: int = 64) -> DataFrame:
    """id and each attribute: the node's own value, else that of the nearest ancestor that has one.

    Looked at are a node and its ``max_depth`` next ancestors; a missing parent ends the chain, and a
    cycle brings nothing new. Pointers double: after k rounds a node holds, of itself and the 2^k - 1
    ancestors above, the nearest values, and points to the next above these. What a pointer leads to is
    folded in, so a round has as many rows as there are nodes, and their number is logarithmic in the
    depth. Ids are unique.
    """
    held = lambda prefix: [F.col(a).alias(f"{prefix}{a}") for a in attributes]
    fold = [F.coalesce(F.col(a), F.col(f"_{a}")).alias(a) for a in attributes]
    nothing = [F.lit(None).cast(nodes.schema[a].dataType).alias(a) for a in attributes]

    def through(df: DataFrame, span: DataFrame) -> DataFrame:
        """``df`` (id, to, values) with what its pointers lead to folded in."""
        above = met(span.select(F.col("id").alias("_id"), F.col("to").alias("_to"), *held("_"))).withColumn("_dealt", F.lit(0).cast("long"))
        return df.join(above, (df["to"] == above["_id"]) & (_dealt(df["to"], df["id"]) == above["_dealt"]), "left").select("id", F.col("_to").alias("to"), *fold)

    # ``span`` covers 2^k nodes; ``out`` those of the depth's lower bits, from which its pointer leads on.
    span = nodes.select("id", F.col("parent").alias("to"), *attributes)
    out, left = nodes.select("id", F.col("id").alias("to"), *nothing), max_depth + 1
    while left:
        if left & 1:
            out = through(out, span)
        left >>= 1
        if left:
            span = stored(through(span, span), "span")
            if span.where("to is not null").isEmpty():
                # All chains have ended within the span.
                out = through(out, span)
                break
            out = stored(out, "inherited")
    return out.select("id", *attributes)


def resolve_cascade(items: DataFrame, styles: DataFrame, properties: list[str], toggles: list[str], defaults: dict, exclusive: list[tuple[str, str]] | None = None) -> DataFrame:
    """ord and each property: defaults, then the table, then style chains from root to leaf, then direct values.

    ``items``: ord, style (paragraph), char_style, direct values as ``d_<property>``, and values of
    the table around as ``t_<property>`` where there are any. ``styles``: id, based_on, properties. A
    toggle that paragraph and character style both set is their exclusive or. Properties that exclude
    each other (first-line and hanging indent) come from one layer: whatever sets one of them unsets
    the other of the layers below. No default style applies once one is named; a cycle or an unknown
    parent ends the chain.
    """
    pairs = exclusive or []
    whole = {f"_x{i}": pair for i, pair in enumerate(pairs)}
    names = [p for p in properties if not any(p in pair for pair in pairs)] + list(whole)

    def layer(prefix: str, df: DataFrame) -> dict[str, Column]:
        """Columns of the properties of a layer, excluding ones as one struct; what the layer lacks is left out."""
        found = {p: F.col(prefix + p) for p in names if prefix + p in df.columns}
        for x, pair in whole.items():
            if any(prefix + p in df.columns for p in pair):
                parts = [F.col(prefix + p) if prefix + p in df.columns else F.lit(None) for p in pair]
                some = parts[0].isNotNull() | parts[1].isNotNull()
                found[x] = F.when(some, F.struct(*(c.cast("double").alias(p) for c, p in zip(parts, pair))))
        return found

    own = layer("", styles)
    resolved = inherit_attributes(styles.select("id", F.col("based_on").alias("parent"), *(c.alias(p) for p, c in own.items())), list(own))
    resolved = stored(resolved, "resolved")
    para = met(resolved.select(F.col("id").alias("style"), *(F.col(p).alias(f"p_{p}") for p in own)))
    char = met(resolved.select(F.col("id").alias("char_style"), *(F.col(p).alias(f"c_{p}") for p in own)))
    joined = items.join(para, "style", "left").join(char, "char_style", "left")
    direct, table = layer("d_", items), layer("t_", items)
    out = {}
    for p in names:
        styled = []
        if p in own:
            styled = [F.coalesce(f"c_{p}", f"p_{p}")]
            if p in toggles:
                both = F.col(f"c_{p}").isNotNull() & F.col(f"p_{p}").isNotNull()
                styled = [F.when(both, F.col(f"c_{p}") != F.col(f"p_{p}")).otherwise(styled[0])]
        layers = [*([direct[p]] if p in direct else []), *styled, *([table[p]] if p in table else [])]
        if p in whole:
            default = F.struct(*(F.lit(defaults.get(q)).cast("double").alias(q) for q in whole[p]))
            value = F.coalesce(*layers, default)
            out |= {q: value[q] for q in whole[p]}
        else:
            out[p] = F.coalesce(*layers, F.lit(defaults.get(p)))
    return joined.select("ord", *(out[p].alias(p) for p in properties))


def ranked_lookup(requests: DataFrame, catalog: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """req, want, found, rank: exact name (1), base name (2), the category's list (3), the other lists (4), anything (5).

    ``requests``: req, want, category; ``catalog``: name, pref (smaller is better), category.
    ``chains``: category, place, name gives each category's list of preferred names; the first that
    the catalog has counts, and of the other lists the first of the first. Without chains a list is
    the catalog's names of the category by pref. The base name ends at the first comma or hyphen. A
    rank above 1 is a substitution.
    """
    names = catalog.groupBy("name").agg(F.min("pref").alias("pref"))
    if chains is None:
        lists = catalog.groupBy("category", "name").agg(F.min("pref").alias("place"))
    else:
        lists = chains.join(names.select("name"), "name", "left_semi")
    base = F.split("want", "[,-]")[0]
    exact = requests.join(names, requests["want"] == names["name"]).select("req", "name", F.lit(1).alias("rank"))
    by_base = requests.join(names, base == names["name"]).select("req", "name", F.lit(2).alias("rank"))
    best = lists.groupBy("category").agg(F.min(F.struct("place", "name")).alias("b"))
    by_category = requests.join(best, "category").select("req", F.col("b.name").alias("name"), F.lit(3).alias("rank"))
    found = exact.unionByName(by_base).unionByName(by_category).groupBy("req").agg(F.min(F.struct("rank", "name")).alias("f"))
    # One row: the best of all lists, and the best name of the catalog.
    rest = best.agg(F.min(F.struct("b.place", "b.name"))["name"].alias("listed")).crossJoin(names.agg(F.min(F.struct("pref", "name"))["name"].alias("any")))
    joined = requests.join(found, "req", "left").crossJoin(F.broadcast(rest))
    rank = F.coalesce("f.rank", F.when(F.col("listed").isNotNull(), 4).when(F.col("any").isNotNull(), 5))
    return joined.select("req", "want", F.coalesce("f.name", "listed", "any").alias("found"), rank.alias("rank"))


def chase_links(start: DataFrame, links: DataFrame, max_hops: int = 4) -> DataFrame:
    """id, terminal: follow ``links`` (id, next) until a row without next; null after ``max_hops`` visits.

    A missing row also gives null.
    """
    out = start.select("id", F.col("id").alias("at"), F.lit(None).cast("string").alias("terminal"))
    hop = met(links.select(F.col("id").alias("at"), F.col("next"), F.lit(True).alias("there"), F.lit(0).cast("long").alias("_dealt")))
    for _ in range(max_hops):
        out = out.withColumn("_dealt", _dealt(F.col("at"), F.col("id"))).join(hop, ["at", "_dealt"], "left").select("id", F.when(F.col("terminal").isNull(), F.col("next")).alias("at"), F.coalesce("terminal", F.when(F.col("there") & F.col("next").isNull(), F.col("at"))).alias("terminal"))
    return out.select("id", "terminal")


def match_sequences(ours: DataFrame, reference: DataFrame, lookahead: int = 60) -> DataFrame:
    """doc, line_ref, line_ours, same_page, dx, dy: greedy alignment of the lines of two sides.

    Both tables: doc, line, text (already normalised) and, if offsets are wanted, page, x and y. For
    each reference line in order the first equal line within the next ``lookahead`` of ours after the
    last match is taken. Offsets are given where both lines are on the same page. Lines of fewer than
    two characters are left out. The walk depends on its past, so a document's lines are two arrays and
    the walk is a fold over places: a line is looked up in the slice of ours after the last match.
    """
    places = ["page", "x", "y"]

    def sides(df: DataFrame, name: str) -> DataFrame:
        # Fresh columns, as both sides may come from one table.
        extra = [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in places]
        rows = df.where(F.length("text") >= 2).select(F.col("doc").alias("doc"), F.struct(F.col("line").cast("long").alias("line"), F.col("text").alias("text"), *extra).alias("l"))
        own = rows.groupBy("doc").agg(F.array_sort(F.collect_list("l")).alias(name))
        return own.withColumn(f"{name}_texts", F.transform(name, lambda x: x["text"]))

    def step(at: Column, i: Column) -> Column:
        place = F.array_position(F.slice("a_texts", at + 1, lookahead), F.get("b_texts", i)).cast("int")
        return let(place, lambda p: F.struct(F.when(p > 0, at + p).otherwise(at).alias("at"), F.when(p > 0, F.struct(i.alias("i"), (at + p - 1).alias("k"))).alias("item")))

    both = sides(ours, "a").join(sides(reference, "b"), "doc")
    matched = walk(F.size("b_texts"), F.lit(0), ("int", "struct<i:int,k:int>"), step)
    pairs = both.withColumn("m", matched).select("doc", F.explode(F.transform("m", lambda m: F.struct(F.get("b", m["i"]).alias("r"), F.get("a", m["k"]).alias("o")))).alias("p")).select("doc", "p.*")
    same = F.coalesce(F.col("r.page") == F.col("o.page"), F.lit(False))
    gap = lambda c: F.when(same, F.abs(F.col(f"o.{c}") - F.col(f"r.{c}")))
    return pairs.select("doc", F.col("r.line").alias("line_ref"), F.col("o.line").alias("line_ours"), same.alias("same_page"), gap("x").alias("dx"), gap("y").alias("dy"))


def _grams(chars: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n characters from each place on."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out ^ chars[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _places(ours: str, reference: str, offsets: np.ndarray, snippet: int) -> list[int]:
    """For each offset of the reference the place in our text of its next characters, nearest to the proportional place.

    -1 if they stand nowhere, -2 if there are none. All snippets of a length are met at once: the grams
    of our text are looked up among theirs, so a text is read once however many page starts it has.
    """
    if ours == reference:
        return [int(o) if o < len(reference) else -2 for o in offsets]
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) for t in (ours, reference))
    sizes, out = np.clip(len(b) - offsets, 0, snippet), np.full(len(offsets), -1, np.int64)
    out[sizes == 0] = -2
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        wanted, key = np.unique(_grams(b, offsets[rows], n), return_inverse=True)
        grams = _grams(a, np.arange(max(len(a) - n + 1, 0)), n)
        slot = np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)
        found = np.flatnonzero(wanted[slot] == grams)
        found = found[np.argsort(slot[found], kind="stable")]
        edge = np.searchsorted(slot[found], np.arange(len(wanted) + 1))
        for row, k in zip(rows.tolist(), key.tolist()):
            part, want = b[offsets[row] : offsets[row] + n], offsets[row] * len(a) / max(len(b), 1)
            places = found[edge[k] : edge[k + 1]]
            up = int(np.searchsorted(places, want))
            down = up - 1
            # Outwards from the wanted place, the lower of equally near ones first; hashes alone decide nothing.
            while down >= 0 or up < len(places):
                if up >= len(places) or down >= 0 and want - places[down] <= places[up] - want:
                    at, down = int(places[down]), down - 1
                else:
                    at, up = int(places[up]), up + 1
                if (a[at : at + n] == part).all():
                    out[row] = at
                    break
    return out.tolist()


def boundary_drift(ours: DataFrame, reference: DataFrame, snippet: int = 12) -> DataFrame:
    """doc, bd_max, bd_sum, unmatched: how far page starts drift, in lines.

    Both tables: doc, page, line, text; lines are joined in order. Each reference page start but the
    first is looked up in our text by its next ``snippet`` characters (at the same offset if the texts
    are equal, else at the occurrence nearest to the proportional place); the drift is the number of
    our line starts between there and our start of that page.
    """

    def offsets(df: DataFrame) -> DataFrame:
        before = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("off", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("long"))

    def whole(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "").alias(name))

    def starts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("doc", "page").agg(F.min("off").alias(name))

    a, b = offsets(ours), offsets(reference)
    texts = whole(a, "ta").join(whole(b, "tb"), "doc")
    paged = lambda df, name: starts(df, name).withColumn("k", F.dense_rank().over(Window.partitionBy("doc").orderBy("page")) - 1)
    targets = paged(b, "roff").where("k > 0").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("k", "roff"))).alias("t"))

    @F.pandas_udf("array<bigint>")
    def places(ta: pd.Series, tb: pd.Series, offsets: pd.Series) -> pd.Series:
        """For each page start its place in our text: -1 if it is not found, -2 if there is nothing to look for."""
        return pd.Series([_places(x, y, np.asarray(own, np.int64), snippet) for x, y, own in zip(ta, tb, offsets)])

    joined = texts.join(targets, "doc").withColumn("pos", places("ta", "tb", F.transform("t", lambda x: x["roff"])))
    spread = joined.select("doc", F.length("ta").cast("long").alias("size"), F.explode(F.arrays_zip(F.transform("t", lambda x: x["k"]).alias("k"), "pos")).alias("z"))
    found = spread.select("doc", "size", "z.k", "z.pos").where("pos <> -2").join(paged(a, "ooff").drop("page"), ["doc", "k"], "left")
    found = found.select("doc", "k", F.when(F.col("pos") >= 0, F.col("pos")).alias("pos"), F.coalesce("ooff", "size").alias("start"))
    lines = a.select("doc", F.col("off").alias("lo"))
    between = found.where("pos is not null").join(lines, "doc").groupBy("doc", "k").agg(F.count_if((F.col("lo") > F.least("pos", "start")) & (F.col("lo") <= F.greatest("pos", "start"))).alias("bd"))
    return found.join(between, ["doc", "k"], "left").groupBy("doc").agg(F.coalesce(F.max("bd"), F.lit(0)).alias("bd_max"), F.coalesce(F.sum("bd"), F.lit(0)).alias("bd_sum"), F.count_if(F.col("pos").isNull()).alias("unmatched"))


#: Levels of a layout from the whole to the part, each with its own keys below the document.
LAYOUT = {"doc": [], "page": ["page"], "line": ["page", "line"], "frag": ["page", "line", "frag"]}


#: Rows of one side of a layout that a task sorts.
ROWS_PER_TASK = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` in partitions by ``keys``, as many as ``rows`` need: adaptive execution merges others by compressed bytes."""
    return df.repartition(-(-rows // ROWS_PER_TASK), *keys) if rows > ROWS_PER_TASK else df


def first_difference(a: dict[str, DataFrame], b: dict[str, DataFrame], tolerance: float) -> DataFrame:
    """doc, page, line, frag, reason: for each document the first place at which two sides differ.

    Both sides: tables by level, any of "page" (doc, page, w, h), "line" (doc, page, line, y) and
    "frag" (doc, page, line, frag, x, size, font, text). Compared are, in this order: the number of
    pages; then page by page its size and its number of lines; line by line its baseline and its
    number of fragments; fragment by fragment x, size, font and text. Numbers may differ by
    ``tolerance``. A level that is not given is not compared; counts stand at the level they belong
    to, so that what one side lacks is found before its parts.
    """
    found = []
    far = lambda c: ~F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance, F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull())
    other = lambda c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    values = {"page": ["w", "h"], "line": ["y"], "frag": ["x", "size", "font", "text"]}
    counted = {"page": "doc", "line": "page", "frag": "line"}
    tests = {"page": [("page size", far("w") | far("h"))], "line": [("baseline", far("y"))], "frag": [("x", far("x")), ("size", far("size")), ("font", other("font")), ("text", other("text"))]}
    nothing = F.lit(-1).cast("long")
    rows = a[[k for k in LAYOUT if k in a][-1]].count()

    def places(df: DataFrame, level: str, rank: int, reason: Column) -> DataFrame:
        keys = {k: F.col(k).cast("long") if k in LAYOUT[level] else nothing for k in ("page", "line", "frag")}
        return df.select("doc", F.struct(*(keys[k].alias(k) for k in keys), F.lit(rank).alias("rank"), reason.alias("reason")).alias("d")).where(F.col("d.reason").isNotNull())

    for level in ("page", "line", "frag"):
        if level not in a:
            continue
        above = ["doc", *LAYOUT[counted[level]]]
        sizes = [dealt(x[level].select(*above), rows, *above).groupBy(*above).agg(F.count("*").alias(n)) for x, n in ((a, "a_n"), (b, "b_n"))]
        both = sizes[0].join(sizes[1], above, "full_outer")
        found.append(places(both, counted[level], 1, F.when(~F.col("a_n").eqNullSafe(F.col("b_n")), F.lit(f"{level} count"))))
        keys = ["doc", *LAYOUT[level]]
        side = lambda x, p, level=level, keys=keys: x[level].select(*(F.col(k).alias(k) for k in keys), *(F.col(c).alias(f"{p}_{c}") for c in values[level]))
        met = dealt(side(a, "a"), rows, *keys).join(dealt(side(b, "b"), rows, *keys), keys)
        reason = F.coalesce(*(F.when(c, F.lit(n)) for n, c in tests[level]))
        found.append(places(met, level, 0, reason))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    first = out.groupBy("doc").agg(F.min("d").alias("d"))
    shown = lambda k: F.when(F.col(f"d.{k}") >= 0, F.col(f"d.{k}")).alias(k)
    return first.select("doc", shown("page"), shown("line"), shown("frag"), F.col("d.reason").alias("reason"))


def regression_gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """doc_id, verdict (fail, skip, hint, pass), reasons: current metrics against a baseline."""
    base = baseline.select("doc_id", *(F.col(c).alias(f"b_{c}") for c in ("hash", "pages", "pages_ref", "bd_max", "bd_sum", "ly_median", "ri_mean")))
    joined = current.join(base, "doc_id", "left")
    gap = lambda p: F.abs(F.col(f"{p}pages") - F.col(f"{p}pages_ref"))
    fails = F.array_compact(
        F.array(
            F.when(gap("") > gap("b_"), F.lit("page gap")),
            F.when(F.col("bd_max") > F.col("b_bd_max"), F.lit("drift max")),
            F.when(F.col("bd_sum") > F.col("b_bd_sum"), F.lit("drift sum")),
            F.when(F.col("ly_median") > F.col("b_ly_median") + 0.2, F.lit("baseline median")),
        )
    )
    hint = F.col("ri_mean") < F.col("b_ri_mean") - 0.02
    missing, changed = F.col("b_hash").isNull(), F.col("hash") != F.col("b_hash")
    verdict = F.when(missing, "fail").when(changed, "skip").when(F.size(fails) > 0, "fail").when(hint, "hint").otherwise("pass")
    reasons = F.when(missing, "not in the baseline").when(changed, "source changed").otherwise(F.array_join(fails, ", "))
    return joined.select("doc_id", verdict.alias("verdict"), reasons.alias("reasons"))


def mask_iou(a: DataFrame, b: DataFrame, width: int, height: int, keys: DataFrame) -> DataFrame:
    """key, iou: intersection over union of two cell sets on the common area; 1 if both are empty.

    Cells are packed to 64-bit words first, so the two sides meet by words and not by cells.
    """
    sides = (masks.clip(masks.pack(cells, "key"), width, height) for cells in (a, b))
    counts = masks.overlap(*sides, keys)
    return counts.select("key", F.when(F.col("either") == 0, 1.0).otherwise(F.round(F.col("both") / F.col("either"), 6)).alias("iou"))


def asof_next(positions: DataFrame, stops: DataFrame, default: float, spread: int | None = None) -> DataFrame:
    """id, grp, x, stop: the first stop of the group beyond x + 0.001, else the next multiple of ``default``.

    One ordered pass over positions and stops of a group, from the largest down: the last stop passed
    is the next one. No pair of them is ever formed. ``spread``: for groups larger than a task, see
    `Ordered`.
    """
    default = max(default, 1.0)
    rows = positions.select("grp", (F.col("x") + 0.001).alias("at"), F.lit(1).alias("kind"), "id", "x", F.lit(None).cast("double").alias("pos"))
    marks = stops.select("grp", F.col("pos").cast("double").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("x"), F.col("pos").cast("double").alias("pos"))
    # At equal places the position comes first, so that it does not meet the stop.
    order = [F.desc("at"), F.desc("kind"), F.asc("id")]
    found = Ordered(rows.unionByName(marks), ["grp"], order, spread).last(next=F.col("pos")).done().where("kind = 1")
    fallback = (F.floor(F.col("at") / default) + 1) * default
    return found.select("id", "grp", "x", F.round(F.coalesce("next", fallback.cast("double")), 6).alias("stop"))


def merge_overrides(base: DataFrame, over: DataFrame, keys: list[str], kind: str = "kind", clear: str = "clear") -> DataFrame:
    """``base`` with overrides: one at the same place replaces it, one of kind ``clear`` deletes it."""
    return base.join(over.select(*keys), keys, "left_anti").unionByName(over.where(F.col(kind) != clear))


def resolve_relationships(refs: DataFrame, rels: DataFrame) -> DataFrame:
    """ref, kind, target: pictures take internal targets only, links external ones only, else null.

    Where both tables have ``part`` (the body, a header), a reference is looked up among the relations
    of its own part.
    """
    want_external = F.col("kind") == "link"
    by_part = "part" in refs.columns and "part" in rels.columns
    r = rels.select(F.col("rel_id").alias("_id"), "target", "external", *([F.col("part").alias("_part")] if by_part else []))
    same = (refs["rel_id"] == r["_id"]) & (r["external"] == want_external)
    if by_part:
        same = same & refs["part"].eqNullSafe(r["_part"])
    return refs.join(r, same, "left").select("ref", "kind", "target")


@functools.cache
def _marks_and_controls() -> np.ndarray:
    """For each code point: 1 for a combining mark, 2 for a control, else 0."""
    category = unicodedata.category
    kinds = {"Mn": 1, "Mc": 1, "Me": 1, "Cc": 2}
    return np.fromiter((kinds.get(category(chr(c)), 0) for c in range(CODE_POINTS)), np.uint8, CODE_POINTS)


def coverage_split(texts: DataFrame, coverage: DataFrame) -> DataFrame:
    """doc_id, start, end, dict, missing: runs of characters of texts covered by the same dictionary.

    ``texts``: doc_id, text; ``coverage``: ch, dict. Each character takes the dictionary of the smallest
    number that covers it, else dictionary 1, reported as missing; a combining mark follows the
    character before it (dictionary 1 where there is none, or a control); controls stand alone. Any
    character and any dictionary number may occur; null and empty texts have no runs.

    The dictionaries become ranges of code points with one number each, fewer than there are code
    points, and travel with the tasks. A text is an array of code points, its numbers one look-up, and
    a run ends where a character differs from its neighbour. No row of a character is made, and a
    task's Python holds the arrays of ``AT_ONCE`` characters, or of one longer text.
    """
    own = coverage.where("dict is not null and length(ch) > 0").groupBy(F.ascii("ch").alias("c")).agg(F.min(F.col("dict").cast("int")).alias("d"))
    # Neighbouring code points of one number are a range: their distance to their rank is the same.
    rank = F.col("c") - F.row_number().over(Window.partitionBy("d").orderBy("c"))
    ranges = own.withColumn("_r", rank).groupBy("d", "_r").agg(F.min("c").alias("low"), F.max("c").alias("high")).orderBy("low")
    found = [(r["low"], r["high"], r["d"]) for r in ranges.collect()]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, covered, kinds = np.ones(CODE_POINTS, np.int32), np.zeros(CODE_POINTS, bool), _marks_and_controls()
        for low, high, d in found:
            number[low : high + 1], covered[low : high + 1] = d, True
        for batch in batches:
            for ids, chars, first in characters(batch):
                d, known, kind, place = number[chars], covered[chars], kinds[chars], np.arange(len(chars))
                begins = np.zeros(len(chars), bool)
                begins[first] = True
                if (kind == 1).any():
                    mark = kind == 1
                    # The last character up to here that is no mark, or a mark that its text begins with.
                    base = np.maximum.accumulate(np.where(mark & ~begins, 0, place))
                    free = mark & (mark[base] | (kind[base] == 2))
                    d, known = np.where(free, 1, d[base]), np.where(free, True, known[base])
                control = kind == 2
                begins[1:] |= control[1:] | control[:-1] | (d[1:] != d[:-1]) | (known[1:] != known[:-1])
                start, columns = stretches(ids, first, begins)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(d[start]), pa.array(~known[start])], ["doc_id", "start", "end", "dict", "missing"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.where("length(text) > 0").select("doc_id", "text").mapInArrow(split, f"doc_id {kind}, start int, end int, dict int, missing boolean")
