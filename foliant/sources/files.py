"""Files: listing, routing by type, content signatures, output names, guarded writes, pending work."""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.folds import walk
from ..functions.text import natural_key
from ..operators.project import expand_page_ranges
from ..storage import bounded, stored

#: Which extension goes where.
ROUTES = {
    "word": ["docx", "doc"],
    "pdf": ["pdf"],
    "image": ["jpg", "jpeg", "jpe", "jfif", "png", "gif", "bmp", "tif", "tiff", "webp", "ico", "tga", "pnm", "ppm", "pgm", "pbm", "pam", "qoi"],
    "heif": ["heic", "heif", "hif"],
}
#: Leading bytes (hex) in the order in which they are tried.
SIGNATURES = [("FFD8FF", "jpeg"), ("89504E470D0A1A0A", "png"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("D0CF11E0A1B11AE1", "cfb")]


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """path, below (the path under ``root``), length, modified of what Spark's reader lists."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # Readers give whole paths; what lies below begins after the root's.
    size = len(root.rstrip("/")) + 1
    return files.select("path", F.substring("path", F.lit(size + 1), F.length("path")).alias("below"), "length", F.col("modificationTime").alias("modified"))


def scan_files(spark: SparkSession, roots: str | list[str], max_depth: int = 8, limit: int | None = None) -> DataFrame:
    """path, name, depth, length, modified of all files below the roots, in natural order of the path.

    Names that begin with a dot hide themselves and everything below; ``max_depth`` levels are
    descended. Only metadata is read. ``limit`` keeps the first files of the order. Spark's readers
    pass over names that begin with an underscore: those are looked up one level at a time, folders
    among them are read as roots of their own, and files come as the few rows that they are.
    """
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    tables, extra = [], []
    for root in [roots] if isinstance(roots, str) else roots:
        at = jvm.Path(root)
        system = at.getFileSystem(conf)
        whole = system.makeQualified(at).toString().rstrip("/")
        # (folder to list, what lies between the root and it)
        todo = [(whole, "")]
        while todo:
            folder, prefix = todo.pop()
            tables.append(_listed(spark, folder).withColumn("below", F.concat(F.lit(prefix), "below")))
            for depth in range(max_depth + 1 - prefix.count("/")):
                # Below a folder whose name is met here, that folder's own turn finds the rest.
                for status in system.globStatus(jvm.Path(folder + "/[!._]*" * depth + "/_*")) or []:
                    path = status.getPath().toString()
                    below = prefix + path[len(folder) + 1 :]
                    if status.isDirectory():
                        if below.count("/") < max_depth:
                            todo.append((path, below + "/"))
                    else:
                        extra.append((path, below, status.getLen(), status.getModificationTime() / 1000))
    rows = spark.createDataFrame(extra, "path string, below string, length long, modified double").withColumn("modified", F.timestamp_seconds("modified"))
    for t in tables:
        rows = rows.unionByName(t)
    parts = F.split("below", "/")
    found = rows.where(~F.exists(parts, lambda p: p.startswith(".")) & (F.size(parts) <= max_depth + 1)).dropDuplicates(["path"])
    ordered = found.select("path", F.element_at(parts, -1).alias("name"), (F.size(parts) - 1).alias("depth"), "length", "modified").orderBy(natural_key(F.col("path")), "path")
    return ordered if limit is None else ordered.limit(limit)


def routes(spark: SparkSession) -> DataFrame:
    """ext, route: the routing dimension, a few dozen rows."""
    return spark.createDataFrame([(e, r) for r, own in ROUTES.items() for e in own], "ext string, route string")


def route_by_type(files: DataFrame, rules: DataFrame, examples: int = 3) -> DataFrame:
    """route, n, notice: files by the route of their extension; the notice lists the first names.

    Names are picked by ``ord``; more than ``examples`` files end in an ellipsis. The rules are
    broadcast if they are small.
    """
    rules = bounded(rules)
    routed = files.join(rules, F.lower(files["ext"]) == rules["ext"], "left").select(files["ord"], files["name"], F.coalesce("route", F.lit("other")).alias("route"))
    numbered = routed.withColumn("rn", F.row_number().over(Window.partitionBy("route").orderBy("ord")))
    first = numbered.where(F.col("rn") <= examples).groupBy("route").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ", ").alias("names"))
    counts = routed.groupBy("route").agg(F.count("*").alias("n"))
    return counts.join(first, "route").select("route", "n", F.concat("names", F.when(F.col("n") > examples, " …").otherwise("")).alias("notice"))


def sniff_content(df: DataFrame, content: str, signatures: list[tuple[str, str]] = SIGNATURES) -> DataFrame:
    """``df`` with ``kind``: the label of the first signature (hex) that the content begins with, else other."""
    head = F.hex(F.substring(F.col(content).cast("binary"), 1, 16))
    out: Column = F.lit("other")
    for prefix, label in reversed(signatures):
        out = F.when(head.startswith(prefix), F.lit(label)).otherwise(out)
    return df.withColumn("kind", out)


_NUMBERED = r"^(.*) \(([1-9][0-9]{0,17})\)$"


def assign_output_names(requests: DataFrame, occupied: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """ord, dir, output: a free file name for each request, in the order of ``ord``.

    ``requests``: ord, dir, stem, ext. ``occupied``: dir, name (inputs and existing files). ``keep``:
    further columns of the requests, which come out after ord. The name
    is ``stem.ext``, else ``stem (2).ext`` and so on: the first, literally, that is neither occupied
    nor issued before. The r-th request of a stem gets the r-th free number, found by one ordered pass
    over requests and taken numbers, so a popular name needs no list in memory.

    Stems that themselves end in " (n)" meet numbers of the stem before that: "a (2)" is what the first
    request of that stem wants, and what "a" gives out second. No other stem wants it, so stems are served
    from the shortest on: with the times at which longer stems ask first, a stem's numbers are settled in one
    walk over the names that it shares, and the longer stems learn which of theirs are gone. Where such
    stems occur, the places of a stem's requests are one array.
    """
    group = ["dir", "_root", "ext"]
    # Written once, as it is read several times and may be a long way from its tables.
    root = stored(requests.withColumns({"_depth": _depth(F.col("stem")), "_root": F.regexp_replace("stem", _SUFFIXES, "")}), "name-requests")
    # Anti and semi joins: only the roots of such stems can be broadcast, never the requests.
    mixed = root.where("_depth > 0").select(*group).distinct()
    # An occupied name is one of a stem with its extension, or of a stem without any.
    name, dot = F.col("name"), F.col("name").rlike(r"^.+\.[^.]*$")
    split = F.when(dot, F.array(F.struct(F.regexp_extract(name, r"^(.+)\.([^.]*)$", 1).alias("stem"), F.regexp_extract(name, r"^(.+)\.([^.]*)$", 2).alias("ext")), F.struct(name.alias("stem"), F.lit("").alias("ext")))).otherwise(F.array(F.struct(name.alias("stem"), F.lit("").alias("ext"))))
    names = occupied.select("dir", "name").distinct().select("dir", F.explode(split).alias("n")).select("dir", "n.stem", "n.ext")
    numbered = names.select("dir", F.regexp_extract("stem", _NUMBERED, 1).alias("stem"), "ext", F.regexp_extract("stem", _NUMBERED, 2).try_cast("long").alias("n")).where("n >= 2")
    taken = names.withColumn("n", F.lit(1).cast("long")).unionByName(numbered)
    keep = keep or []
    placed = _by_number(root.join(mixed, group, "left_anti").drop("_root"), taken, keep)
    shared = stored(root.join(mixed, group, "left_semi").drop("_root"), "mixed-names")
    for depth in sorted(r[0] for r in shared.select("_depth").distinct().collect()):  # as many as suffixes in the longest name
        own, longer = shared.where(F.col("_depth") == depth), shared.where(F.col("_depth") == depth + 1)
        marks = stored(_settled(own, longer, taken), "settled")
        gone = marks.where("not skipped").select("dir", _numbered(F.col("stem"), F.col("n")).alias("stem"), "ext", F.lit(1).cast("long").alias("n"))
        placed = placed.unionByName(_by_number(own, taken.unionByName(marks.where("skipped").select("dir", "stem", "ext", "n")), keep))
        taken = taken.unionByName(gone)
    return placed


_SUFFIXES = r"( \((?:[2-9]|[1-9][0-9]{1,17})\))+$"


def _depth(stem: Column) -> Column:
    """How many numbers, each of 2 or more, a stem ends in."""
    return F.size(F.regexp_extract_all(F.regexp_extract(stem, _SUFFIXES, 0), F.lit(r"\("), F.lit(0)))


def _numbered(stem: Column, n: Column) -> Column:
    return F.when(n == 1, stem).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")")))


def _settled(requests: DataFrame, longer: DataFrame, taken: DataFrame) -> DataFrame:
    """dir, stem, ext, n, skipped: numbers that stems share with longer stems, and who has them.

    Skipped ones went to the longer stem's first request, the others to a request of the stem itself.
    """
    group = ["dir", "stem", "ext"]
    first = longer.groupBy(*group).agg(F.min("ord").alias("o"))
    wished = first.select("dir", F.regexp_extract("stem", _NUMBERED, 1).alias("stem"), "ext", F.regexp_extract("stem", _NUMBERED, 2).cast("long").alias("n"), "o")
    wished = wished.join(taken, [*group, "n"], "left_anti")
    fixed = taken.join(wished.select(*group).distinct(), group, "left_semi").distinct().withColumn("o", F.lit(None).cast("long"))
    marks = wished.unionByName(fixed).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("n", "o"))).alias("marks"))
    places = requests.join(marks.select(*group), group, "left_semi").groupBy(*group).agg(F.sort_array(F.collect_list("ord")).alias("ords"))

    def step(skipped: Column, i: Column) -> Column:
        mark = F.get("marks", i)
        # The request that comes to this number, if there is one.
        ord_ = F.get("ords", (mark["n"] - skipped - 1).cast("int"))
        skip = ord_.isNotNull() & (mark["o"].isNull() | (ord_ > mark["o"]))
        item = F.when(ord_.isNotNull() & mark["o"].isNotNull(), F.struct(mark["n"].alias("n"), skip.alias("skipped")))
        return F.struct((skipped + skip.cast("long")).alias("at"), item.alias("item"))

    found = walk(F.size("marks"), F.lit(0), ("bigint", "struct<n:bigint,skipped:boolean>"), step)
    return places.join(marks, group).select(*group, F.explode(found).alias("m")).select(*group, "m.*")


def _named(stem: Column, ext: Column) -> Column:
    return F.when(ext == "", stem).otherwise(F.concat(stem, F.lit("."), ext))


def _by_number(requests: DataFrame, taken: DataFrame, keep: list[str]) -> DataFrame:
    group = ["dir", "stem", "ext"]
    taken = taken.join(requests.select(*group).distinct(), group, "left_semi").distinct()
    wanted = requests.withColumn("key", F.row_number().over(Window.partitionBy(*group).orderBy("ord")).cast("long")).select(*group, "ord", *keep, "key", F.lit(0).alias("kind"))
    # A taken number n with k taken up to it has n - k free numbers before it.
    before = taken.withColumn("key", F.col("n") - F.row_number().over(Window.partitionBy(*group).orderBy("n"))).select(*group, F.lit(None).cast("long").alias("ord"), "key", F.lit(1).alias("kind"))
    passed = F.sum("kind").over(Window.partitionBy(*group).orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))
    placed = wanted.unionByName(before, allowMissingColumns=True).withColumn("n", F.col("key") + passed).where("kind = 0")
    return placed.select("ord", *keep, "dir", _named(_numbered(F.col("stem"), F.col("n")), F.col("ext")).alias("output"))


def write_guarded(df: DataFrame, path: str, inputs: list[str], file_format: str = "parquet") -> None:
    """Write to a new place only: never over an input, never over anything that exists.

    Spark's commit protocol moves files into place when the job succeeds, so no partial file stays.
    """
    jvm, conf = df.sparkSession._jvm.org.apache.hadoop.fs, df.sparkSession._jsc.hadoopConfiguration()

    def real(p: str) -> str:
        """The path as the file system names it, without "..", and with links followed where there are any."""
        at = jvm.Path(p)
        system = at.getFileSystem(conf)
        name = posixpath.normpath(system.makeQualified(at).toUri().getPath())
        return os.path.realpath(name) if system.getScheme() == "file" else f"{system.getUri()}{name}"

    if real(path) in {real(p) for p in inputs}:
        raise ValueError(f"the target is one of the inputs: {path}")
    df.write.mode("errorifexists").format(file_format).save(path)


def split_every(picks: DataFrame, n: int, stem: str) -> DataFrame:
    """part, name, first, last, pages: output parts of ``n`` picks each; the last may be shorter.

    ``picks`` has pick_no, counted from 1 without gaps.
    """
    parts = picks.groupBy(F.floor((F.col("pick_no") - 1) / n).cast("long").alias("part")).agg(F.min("pick_no").alias("first"), F.max("pick_no").alias("last"), F.count("*").alias("pages"))
    span = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    return parts.select("part", F.concat(F.lit(f"{stem}_p"), span).alias("name"), "first", "last", "pages")


def name_page_images(requests: DataFrame, occupied: DataFrame, ext: str) -> DataFrame:
    """req, pos, page, dir, output: a free file name for each page that the requests ask for.

    ``requests``: req (below 2^31), spec, page_count (as of ``expand_page_ranges``), dir, stem;
    ``occupied``: dir, name. A page is ``stem_p007.ext``, with as many digits as the document's last page
    has, three at least. Names are given in the order of requests and pages; requests in error have none.
    """
    # What names need of a request comes along with its pages: nothing is joined, and so nothing broadcast.
    digits = F.greatest(F.lit(3), F.length(F.col("page_count").cast("string"))).alias("_digits")
    pages = expand_page_ranges(requests.select("req", "spec", "page_count", "dir", "stem", digits), ["dir", "stem", "_digits"]).where("error is null")
    shown = F.col("page").cast("string")
    wanted = pages.withColumn("stem", F.concat("stem", F.lit("_p"), F.repeat(F.lit("0"), (F.col("_digits") - F.length(shown)).cast("int")), shown))
    wanted = wanted.select("req", "pos", "page", (F.shiftleft(F.col("req").cast("long"), 32) + F.col("pos")).alias("ord"), "dir", "stem", F.lit(ext).alias("ext"))
    return assign_output_names(wanted, occupied, ["req", "pos", "page"]).drop("ord")


def incremental_pending(files: DataFrame, done: DataFrame, key: str = "hash", order: str = "ord") -> DataFrame:
    """All files with ``state``: done (hash already converted), convert (first of a new hash) or reuse.

    Equal contents are converted once; the first by ``order`` does it.
    """
    first = files.groupBy(key).agg(F.min(order).alias("_first"))
    known = done.select(F.col(key)).distinct().withColumn("_done", F.lit(True))
    joined = files.join(first, key).join(known, key, "left")
    state = F.when(F.col("_done"), "done").when(F.col(order) == F.col("_first"), "convert").otherwise("reuse")
    return joined.withColumn("state", state).drop("_first", "_done")
