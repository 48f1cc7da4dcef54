"""Aggregations: spans of time, compression results, batch and warning summaries, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import Ordered

#: Reasons for leaving an image as it is, in the order in which they are listed.
SKIPS = ["cmyk", "special", "mask", "transparency", "jpeg2000", "other", "decode", "undecodable"]


def capture_span(times: DataFrame, now: Column) -> DataFrame:
    """batch, earliest, latest, untrusted, creation, creation_is_capture, warning.

    ``times``: batch, when (sortable, null if none), is_capture_time. Only capture times span; files
    with some time but no capture time are counted; without any capture time the creation is ``now``.
    """
    trusted = F.when(F.col("is_capture_time"), F.col("when"))
    spans = times.groupBy("batch").agg(F.min(trusted).alias("earliest"), F.max(trusted).alias("latest"), F.count_if(F.col("when").isNotNull() & ~F.col("is_capture_time")).alias("untrusted"))
    known = F.col("earliest").isNotNull()
    return spans.select("*", F.coalesce("earliest", now).alias("creation"), known.alias("creation_is_capture"), F.when(F.col("untrusted") > 0, F.concat(F.col("untrusted").cast("string"), F.lit(" without capture time"))).alias("warning"))


def fidelity_counts(images: DataFrame, batch: str) -> DataFrame:
    """batch, fidelity, n; classes that do not occur have no row."""
    return images.groupBy(batch, "fidelity").agg(F.count("*").alias("n"))


def compression_rollup(decisions: DataFrame, group: str) -> DataFrame:
    """Per document: recompressed, kept, optimal, skipped, skips, is_mostly_vector, before, after, saved_ratio, unchanged.

    ``decisions``: decision ("replace", "kept", "optimal", "tiny", "skip:<reason>"), stored_len,
    chosen_len. ``skips`` lists reasons with counts in their fixed order. A result that is not smaller
    returns the original unchanged.
    """
    is_ = lambda d: F.count_if(F.col("decision") == d)
    reasons = [is_(f"skip:{s}").alias(f"_{s}") for s in SKIPS]
    sums = decisions.groupBy(group).agg(is_("replace").alias("recompressed"), is_("kept").alias("kept"), is_("optimal").alias("optimal"), F.count_if(F.col("decision").startswith("skip:")).alias("skipped"), *reasons, F.sum("stored_len").alias("before"), F.sum("chosen_len").alias("after"))
    skips = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"_{s}") > 0, F.concat(F.lit(f"{s}:"), F.col(f"_{s}").cast("string"))) for s in SKIPS))), ",")
    final = F.least("before", "after")
    vector = F.col("recompressed") + F.col("kept") + F.col("optimal") + F.col("skipped") == 0
    ratio = F.when(F.col("before") > 0, F.round(1 - final / F.col("before"), 6)).otherwise(F.lit(0.0))
    return sums.select(group, "recompressed", "kept", "optimal", "skipped", skips.alias("skips"), vector.alias("is_mostly_vector"), "before", final.alias("after"), ratio.alias("saved_ratio"), (F.col("after") >= F.col("before")).alias("unchanged"))


def batch_summary(results: DataFrame) -> DataFrame:
    """batch, succeeded, failed, last_output, first_error, before, after, saved_ratio, batch_failed.

    First and last go by input order (``ord``), not by completion; a batch fails if nothing succeeded.
    """
    ok = F.col("error").isNull()
    sums = results.groupBy("batch").agg(
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.max_by("output", F.when(ok & F.col("output").isNotNull(), F.col("ord"))).alias("last_output"),
        F.min_by("error", F.when(~ok, F.col("ord"))).alias("first_error"),
        F.coalesce(F.sum(F.when(ok, F.col("before"))), F.lit(0)).alias("before"),
        F.coalesce(F.sum(F.when(ok, F.col("after"))), F.lit(0)).alias("after"),
    )
    return sums.withColumn("saved_ratio", F.when(F.col("before") > 0, F.round(1 - F.col("after") / F.col("before"), 6)).otherwise(F.lit(0.0))).withColumn("batch_failed", F.col("succeeded") == 0)


def warning_summary(warnings: DataFrame, names: int = 3) -> DataFrame:
    """item, kind, n, distinct_details, details: a line per item and kind; its first details by name.

    Repeats are counted before details are ranked, so a frequent detail is one row.
    """
    counted = warnings.groupBy("item", "kind", "detail").agg(F.count("*").alias("c"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("item", "kind").orderBy("detail")))
    first = F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= names, F.col("detail")))), "; ")
    lines = ranked.groupBy("item", "kind").agg(F.sum("c").alias("n"), F.count("*").alias("distinct_details"), first.alias("details"))
    return lines.select("item", "kind", "n", "distinct_details", F.concat("details", F.when(F.col("distinct_details") > names, " …").otherwise("")).alias("details"))


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, median: the element in the middle, the upper one of two, by rank and not by a list."""
    order = Window.partitionBy(group).orderBy(value)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(order))
    half = df.groupBy(group).agg(F.floor(F.count(value) / 2).alias("_half"))
    return ranked.join(half, group).where(F.col("_r") == F.col("_half") + 1).select(group, F.col(value).alias("median"))


def compare_metrics(matches: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, pages_ours, pages_ref, differing, matched, offset_median, offset_max, iou_mean, iou_min.

    ``matches``: doc, offset (null where the pages differ). ``pages``: doc, page, ours, ref (texts,
    null where a side has no such page), iou (null if not measured).
    """
    both = F.col("ours").isNotNull() & F.col("ref").isNotNull()
    sides = pages.groupBy("doc").agg(F.count("ours").alias("pages_ours"), F.count("ref").alias("pages_ref"), F.count_if(both & (F.col("ours") != F.col("ref"))).alias("d"), F.round(F.coalesce(F.avg("iou"), F.lit(1.0)), 6).alias("iou_mean"), F.round(F.coalesce(F.min("iou"), F.lit(1.0)), 6).alias("iou_min"))
    sums = matches.groupBy("doc").agg(F.count("*").alias("matched"), F.coalesce(F.max("offset"), F.lit(0.0)).alias("offset_max"))
    joined = sides.join(sums, "doc", "left").join(upper_median(matches, "doc", "offset"), "doc", "left")
    return joined.select("doc", "pages_ours", "pages_ref", (F.col("d") + F.abs(F.col("pages_ours") - F.col("pages_ref"))).alias("differing"), F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("median", F.lit(0.0)).alias("offset_median"), F.coalesce("offset_max", F.lit(0.0)).alias("offset_max"), "iou_mean", "iou_min")


def estimate_by_systematic_sample(rows: DataFrame, group: str, order: str, measure: Column, every: int = 8, spread: int | None = None) -> DataFrame:
    """group, estimate: every n-th row from the first is measured and extrapolated, in integers.

    One row or none is exact. ``spread``: for groups larger than a task, see `Ordered`.
    """
    numbered = Ordered(rows, [group], [order], spread).running(_place=F.lit(1)).done()
    picked = (F.col("_place") - 1) % every == 0
    sums = numbered.groupBy(group).agg(F.sum(F.when(picked, measure)).alias("s"), F.count("*").alias("n"), F.count_if(picked).alias("k"))
    return sums.select(group, F.expr("s * n div k").alias("estimate"))


def set_parity(a: DataFrame, b: DataFrame, group: str, key: str) -> DataFrame:
    """group, equal, only_a, only_b, common: distinct names on two sides."""
    left = a.select(group, key).distinct().withColumn("a", F.lit(1))
    right = b.select(group, key).distinct().withColumn("b", F.lit(1))
    both = left.join(right, [group, key], "full_outer")
    only = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col(key)))), ",")
    lacks_a, lacks_b = F.col("a").isNull(), F.col("b").isNull()
    return both.groupBy(group).agg((F.count_if(lacks_a | lacks_b) == 0).alias("equal"), only(lacks_b).alias("only_a"), only(lacks_a).alias("only_b"), F.count_if(~lacks_a & ~lacks_b).alias("common"))


def mask_stats(cells: DataFrame, masks: DataFrame) -> DataFrame:
    """mask, n, x0, y0, x1, y1: number of cells and bounding box (null if empty, end exclusive)."""
    box = cells.groupBy("mask").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    return masks.select("mask").join(box, "mask", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def column_grid(cells: DataFrame, declared: DataFrame, width: float, limit: int = 63, least: float = 18.0) -> DataFrame:
    """tbl, columns, known, share, placeholder: the number of columns a table needs and their widths.

    ``cells``: tbl, r, grid_span, w (width of the cell, 0 if unknown), c, and where rows have them
    ``before`` and ``after``: columns that the row leaves out at its ends. ``declared``: tbl, n, known
    (columns of the declared grid and their total width). Columns beyond the declared grid take the
    first non-zero width of a single-span cell; the others share what is left, ``least`` at least.
    Tables of more than ``limit`` columns become placeholders.
    """
    left = Window.partitionBy("tbl", "r").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    ends = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in cells.columns else F.lit(0)
    placed = cells.withColumn("start", ends("before") + F.coalesce(F.sum("grid_span").over(left), F.lit(0)))
    need = placed.groupBy("tbl").agg(F.max(F.col("start") + F.col("grid_span") + ends("after")).alias("need"))
    beyond = placed.join(declared, "tbl").where("start >= n and grid_span = 1 and w > 0").groupBy("tbl", "start").agg(F.min_by("w", F.struct("r", "c")).alias("w"))
    widths = beyond.groupBy("tbl").agg(F.count("*").alias("found"), F.sum("w").alias("found_w"))
    joined = declared.join(need, "tbl").join(widths, "tbl", "left")
    columns = F.greatest("need", "n")
    known = F.col("known") + F.coalesce("found_w", F.lit(0.0))
    unknown = columns - F.col("n") - F.coalesce("found", F.lit(0))
    share = F.when(unknown > 0, F.greatest((F.lit(width) - known) / unknown, F.lit(least)))
    return joined.select("tbl", columns.alias("columns"), F.round(known, 6).alias("known"), F.round(share, 6).alias("share"), (columns > limit).alias("placeholder"))


def feature_census(items: DataFrame, group: str, features: dict[str, Column]) -> DataFrame:
    """group, feature, n: how often each condition holds; conditions that never hold have no row."""
    sums = items.groupBy(group).agg(*(F.count_if(c).alias(n) for n, c in features.items()))
    return sums.unpivot([group], list(features), "feature", "n").where("n > 0")
