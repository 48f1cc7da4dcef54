"""Projections and predicates: gates, page ranges, image plans, recompression decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, natural_key
from ..storage import stored
from . import masks

A4_LONG_EDGE, MAX_PAGE = 841.89, 14400.0
#: Resolution cap of each tier (None: pixels are never changed), and whether JPEG bytes may pass through.
TIERS = {"lossless": (None, True, True), "high": (300.0, True, False), "balanced": (200.0, False, False), "extreme": (144.0, False, False)}
LOSSLESS_TOLERANCE = 1.5


def gate_inputs(files: DataFrame, encrypted: Column, signed: DataFrame) -> DataFrame:
    """``files`` with accepted, reason: encrypted ones are rejected first, then signed ones.

    ``signed`` holds the doc_id of each signed document (repeats allowed).
    """
    marks = signed.select("doc_id").distinct().withColumn("_signed", F.lit(True))
    reason = F.when(encrypted, "encrypted").when(F.col("_signed"), "signed")
    out = files.join(marks, "doc_id", "left").withColumn("reason", reason)
    return out.withColumn("accepted", F.col("reason").isNull()).drop("_signed")


def expand_page_ranges(requests: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """req, pos, page, error: pages of specifications such as ``1-3,5,8-``, in written order.

    Separators are commas, semicolons and their full-width forms and white space; dashes may be
    hyphen, en or em dash or tilde. Blank means all pages; a page named twice keeps its first place.
    A request in error has one row with the message of its first bad part and no page.
    ``requests``: req, spec, page_count. ``keep``: further columns, which come out before pos.
    """
    parts = F.filter(F.split(F.regexp_replace("spec", r"[,，、;；\s]+", ","), ","), lambda p: p != "")
    blank = F.trim(F.regexp_replace("spec", r"\s+", " ")) == ""
    number = lambda t: t.rlike(r"^\+?[0-9]+$")
    none = F.lit(None).cast("string")

    def ends(q: Column) -> Column:
        """First and last page as written and as numbers, from a part split at its first dash."""
        ranged, a, b = F.size(q) == 2, F.trim(q[0]), F.trim(F.get(q, F.size(q) - 1))
        return F.struct(
            a.alias("a"), b.alias("b"), (ranged & (a == "")).alias("open_a"), (ranged & (b == "")).alias("open_b"),
            number(a).alias("is_a"), number(b).alias("is_b"), a.try_cast("long").alias("from"), b.try_cast("long").alias("to"),
        )

    def judged(e: Column, part: Column) -> Column:
        lo = F.when(e["open_a"], F.lit(1).cast("long")).otherwise(e["from"])
        hi = F.when(e["open_b"], F.col("page_count").cast("long")).otherwise(e["to"])
        bad = F.when(~e["open_a"] & ~e["is_a"], F.concat(F.lit("not a page number: "), e["a"])).when(lo == 0, F.lit("pages count from 1"))
        bad = bad.when(~e["open_b"] & ~e["is_b"], F.concat(F.lit("not a page number: "), e["b"])).when(hi == 0, F.lit("pages count from 1"))
        bad = bad.when((e["b"] != "") & (lo > hi), F.concat(F.lit("first page after last: "), part)).otherwise(none)
        beyond = F.when(lo > F.col("page_count"), lo).when(hi > F.col("page_count"), hi)
        return F.struct(lo.alias("lo"), hi.alias("hi"), bad.alias("bad"), beyond.alias("beyond"))

    def bounds(p: Column) -> Column:
        return let(F.split(p, "[-–—~～]", 2), lambda q: let(ends(q), lambda e: judged(e, p)))

    whole = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    count = F.col("page_count").cast("long")

    def outcome(s: Column) -> Column:
        """The first error, and the pages if there is none."""
        # Bad writing is found before any page is counted, so it comes first.
        bad = F.get(F.filter(s, lambda x: x["bad"].isNotNull()), 0)["bad"]
        beyond = F.get(F.filter(s, lambda x: x["beyond"].isNotNull()), 0)["beyond"]
        error = F.when(blank, none).when(bad.isNotNull(), bad).when(F.size(s) == 0, F.lit("nothing selected")).when(beyond.isNotNull(), F.concat(F.lit("no page "), beyond.cast("string"), F.lit(" of "), count.cast("string")))
        return let(error, lambda e: F.struct(e.alias("error"), F.when(e.isNull(), F.array_distinct(F.when(blank, whole(F.lit(1).cast("long"), count)).otherwise(F.flatten(F.transform(s, lambda x: whole(x["lo"], x["hi"])))))).alias("pages")))

    row = lambda pos, page, error: F.struct(pos.cast("int").alias("pos"), page.cast("long").alias("page"), error.cast("string").alias("error"))

    def rows(o: Column) -> Column:
        listed = F.transform(o["pages"], lambda page, i: row(i, page, F.lit(None)))
        return F.when(o["error"].isNull(), listed).otherwise(F.array(row(F.lit(None), F.lit(None), o["error"])))

    found = let(let(F.transform(parts, bounds), outcome), rows)
    own = ["req", *(keep or [])]
    return requests.select(*own, F.explode(found).alias("r")).select(*own, "r.*")


def page_size(w: Column, h: Column, dpi: Column) -> tuple[Column, Column]:
    """Page width and height in points: by a trusted resolution, else the long edge is that of A4.

    72 and 96 (within one half) are defaults of tools and not trusted.
    """
    w, h = F.greatest(w, F.lit(1)).cast("double"), F.greatest(h, F.lit(1)).cast("double")
    trusted = dpi.isNotNull() & (F.abs(dpi - 72.0) >= 0.5) & (F.abs(dpi - 96.0) >= 0.5)
    scale = F.when(trusted, F.lit(72.0) / dpi).otherwise(F.lit(A4_LONG_EDGE) / F.greatest(w, h))
    over = F.greatest(w * scale / MAX_PAGE, h * scale / MAX_PAGE, F.lit(1.0))
    return F.greatest(w * scale / over, F.lit(1.0)), F.greatest(h * scale / over, F.lit(1.0))


def downscale(w: Column, h: Column, page_w: Column, page_h: Column, cap: float | None) -> tuple[Column, Column, Column]:
    """Effective resolution and target size; the target is null where the image stays as it is."""
    current = F.greatest(w / (page_w / 72.0), h / (page_h / 72.0))
    if cap is None:
        none = F.lit(None).cast("int")
        return current, none, none
    scale = F.lit(cap) / current
    tw = F.greatest(F.round(w * scale).cast("int"), F.lit(1))
    th = F.greatest(F.round(h * scale).cast("int"), F.lit(1))
    shrink = (current > cap * 1.02) & ((tw < w) | (th < h))
    return current, F.when(shrink, tw), F.when(shrink, th)


def plan_downscale(images: DataFrame, tier: str, page: str = "dpi") -> DataFrame:
    """img, page_w, page_h, dpi, target_w, target_h.

    ``page``: "dpi" (trusted resolution), "a4" (always the A4 rule) or "placement" (columns w_pt, h_pt).
    """
    resolution = F.col("dpi").cast("double") if page == "dpi" else F.lit(None).cast("double")
    page_w, page_h = (F.col("w_pt"), F.col("h_pt")) if page == "placement" else page_size(F.col("w"), F.col("h"), resolution)
    sized = images.select("img", "w", "h", page_w.alias("page_w"), page_h.alias("page_h"))
    current, tw, th = downscale(F.col("w"), F.col("h"), F.col("page_w"), F.col("page_h"), TIERS[tier][0])
    return sized.select("img", F.round("page_w", 6).alias("page_w"), F.round("page_h", 6).alias("page_h"), F.round(current, 6).alias("dpi"), tw.alias("target_w"), th.alias("target_h"))


#: Filters whose data can be decoded.
FILTERS = ["DCTDecode", "FlateDecode", "JPXDecode"]


def decide_recompression(images: DataFrame, tier: str = "balanced", grayscale: bool = False) -> DataFrame:
    """``images`` with decision and chosen_len, by an ordered list of reasons.

    Needs filter, bits, components, has_smask, has_decode, w, h, w_pt, h_pt (placement extent),
    stored_len, and the measured candidates jpeg_len and flate_est. A colour model other than gray (1),
    RGB (3) and CMYK (4 components) is "special"; a filter other than ``FILTERS`` is "other"; an image
    without any candidate could not be decoded.
    """
    cap = TIERS[tier][0]
    if cap is None:
        return images.withColumn("decision", F.lit(None).cast("string")).withColumn("chosen_len", F.col("stored_len"))
    _, target_w, _ = downscale(F.col("w"), F.col("h"), F.coalesce("w_pt", F.lit(595.0)), F.coalesce("h_pt", F.lit(842.0)), cap)
    jpeg = F.col("filter") == "DCTDecode"
    to_gray = F.lit(grayscale) & (F.col("components") == 3)
    candidate = F.when(~jpeg & (F.col("flate_est") <= F.col("jpeg_len") * LOSSLESS_TOLERANCE), F.col("flate_est")).otherwise(F.col("jpeg_len"))
    decision = (
        F.when(F.col("bits") != 8, "skip:mask")
        .when(F.col("has_smask"), "skip:transparency")
        .when(F.col("filter") == "JPXDecode", "skip:jpeg2000")
        .when((F.col("w") < 200) | (F.col("h") < 200), "tiny")
        .when(F.col("components") == 4, "skip:cmyk")
        .when(~F.coalesce(F.col("components").isin(1, 3), F.lit(False)), "skip:special")
        .when(~F.coalesce(F.col("filter").isin(*FILTERS), F.lit(False)), "skip:other")
        .when(F.col("jpeg_len").isNull() & F.col("flate_est").isNull(), "skip:undecodable")
        .when(to_gray & F.col("has_decode"), "skip:decode")
        .when(jpeg & target_w.isNull() & ~to_gray, "optimal")
        .when(candidate < F.col("stored_len"), "replace")
        .otherwise("kept")
    )
    out = images.withColumn("decision", decision)
    return out.withColumn("chosen_len", F.when(F.col("decision") == "replace", candidate).otherwise(F.col("stored_len")))


def decide_fidelity(images: DataFrame, tier: str) -> DataFrame:
    """img, doc, fidelity: passthrough, lossless or reencoded.

    JPEG data of 8 bits and one or three components pass through if the tier allows and nothing has
    to shrink; the lossless tier stores losslessly; otherwise the smaller measured form is taken, and
    eligible JPEG data fall back to passing through when the result would not be smaller.
    """
    cap, allowed, lossless = TIERS[tier]
    page_w, page_h = page_size(F.col("w"), F.col("h"), F.col("dpi").cast("double"))
    sized = images.withColumn("_pw", page_w).withColumn("_ph", page_h)
    _, target_w, _ = downscale(F.col("w"), F.col("h"), F.col("_pw"), F.col("_ph"), cap)
    eligible = (F.col("filter") == "DCTDecode") & (F.col("bits") == 8) & F.col("components").isin(1, 3)
    stays_flate = F.col("flate_est") <= F.col("jpeg_len") * LOSSLESS_TOLERANCE
    result = F.when(stays_flate, F.col("flate_est")).otherwise(F.col("jpeg_len"))
    fidelity = (
        F.when(eligible & F.lit(allowed) & target_w.isNull(), "passthrough")
        .when(F.lit(lossless), "lossless")
        .when(eligible & (result >= F.col("stored_len")), "passthrough")
        .when(stays_flate, "lossless")
        .otherwise("reencoded")
    )
    return sized.select("img", "doc", fidelity.alias("fidelity"))


def append_distinct(current: DataFrame, incoming: DataFrame, key: str, order: str, accept: Column) -> tuple[DataFrame, DataFrame]:
    """(list, rejected): incoming rows that are accepted and new are appended, first come first kept.

    Both tables have ``order``; ``rejected`` counts incoming rows that ``accept`` refuses, duplicates
    not included.
    """
    both = current.withColumn("_batch", F.lit(0)).unionByName(incoming.where(F.coalesce(accept, F.lit(False))).withColumn("_batch", F.lit(1)))
    kept = both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_batch", order))).where("_n = 1").drop("_n")
    rejected = incoming.agg(F.count_if(~F.coalesce(accept, F.lit(False))).alias("rejected"))
    return kept.withColumnRenamed("_batch", "batch"), rejected


def top_n_with_more(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group, with ``rank`` and ``more``: whether the group has others."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    counts = df.groupBy(group).agg((F.count("*") > n).alias("more"))
    return ranked.where(F.col("rank") <= n).join(counts, group)


def number_rows(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, in the order of all rows (ties in any order).

    A range sort over all tasks; a place is the row's number in its partition and the sum of the
    partitions before, of which there is one row each.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # Partition numbers become data: a lost executor cannot change them.
    sorted_ = stored(sorted_.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))), "places")
    sizes = sorted_.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = sorted_.join(F.broadcast(sizes.drop("count")), "_part")
    return placed.withColumn(name, (F.coalesce("_before", F.lit(0)) + F.col("_at") + 1).cast("long")).drop("_part", "_at", "_before")


def natural_sort(files: DataFrame, name: str, order: str) -> DataFrame:
    """``files`` with place: by the natural order of the name, then by ``order``."""
    keyed = files.withColumn("_key", natural_key(F.col(name)))
    return number_rows(keyed, [F.col("_key"), F.col(order)]).drop("_key")


def sort_by_time(rows: DataFrame, when: str, order: str) -> DataFrame:
    """``rows`` with place: by a resolved time (a struct, as of ``resolve_capture_time``), missing first, then by ``order``."""
    time = F.when(F.col(when).isNotNull(), F.struct(*(F.col(when)[n] for n in ("year", "month", "day", "hour", "minute", "second"))))
    return number_rows(rows.withColumn("_when", time), [F.col("_when").asc_nulls_first(), F.col(order)]).drop("_when")


def reindex_sources(picks: DataFrame) -> DataFrame:
    """``picks`` with new_source: the used sources numbered from 0 in ascending order."""
    used = number_rows(picks.select("source").distinct(), [F.col("source")], "new_source")
    return picks.join(used.withColumn("new_source", (F.col("new_source") - 1).cast("int")), "source")


def dilate(cells: DataFrame, width: int, height: int) -> DataFrame:
    """mask, x, y: each cell with its eight neighbours, clipped to the bounds; worked on as 64-bit words."""
    return masks.unpack(masks.dilate(masks.pack(cells, "mask"), width, height), "mask")
