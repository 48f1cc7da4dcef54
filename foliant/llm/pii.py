"""Personal data: formal identifiers by pattern, and terms that disclose them by co-occurrence.

Only DataFrame functions are used. Base spans are e-mail addresses, IP numbers, card numbers and
phone numbers. The information-theoretic part then asks which other terms reveal a protected entity.
Protected are classes that a corpus repeats, as most values stand in it once: each kind of base span,
and credentials, which the corpus names by words such as "token" or "password" (``concepts``). A term
is a lower-cased word, or, for a word with digits, its shape: which of letters and digits it holds
and the octave of its length, so that all random keys of a sort are one term.

A place of the corpus is near an entity if at most ``reach`` words part them. With counts of places
over the whole corpus, a term t discloses c to the degree PMI(c; t) / IC(c) = log(p(c|t) / p(c)) /
-log p(c): 1 if t never stands anywhere but near c, 0 if it stands there as often as any word. p(c|t)
is smoothed towards p(c) by ``smoothing`` places, so that a term needs some support. Terms at or above
``remove_at`` are removed, those at or above ``generalise_at`` are replaced by a general class,
wherever they occur, with or without the entity.

Only documents with an entity are laid out word by word; terms that are never near an entity often
enough to reach the lowest degree are not counted any further. The final search looks for the terms
that are left. Broadcasts are checked in bytes; beyond the limit the same joins shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import bounded

#: Fixed kinds of base spans in their order, with patterns that match as the plain ones do but never
#: try a start inside a run that has already failed, and never give back what cannot help.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Something that every match of a kind holds, as a quick first test.
_HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"[\p{L}\p{N}]+"
GAP = r"[^\p{L}\p{N}]+"
#: Words by which texts name credentials.
CONCEPTS = ("token", "password", "passwd", "passphrase", "secret", "apikey", "credential", "credentials", "authorization", "bearer")
#: Names of the classes: the kinds of base spans by their number, then credentials.
CREDENTIAL = len(KINDS)
#: Private characters that stand for base spans while words are laid out: not letters, so no word holds one.
_MARKS = "".join(chr(0xE000 + k) for k in range(len(KINDS)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = lambda c: F.ascii(c) - 48
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, value(c)).otherwise(F.when(value(c) > 4, value(c) * 2 - 9).otherwise(value(c) * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        # A part is at most 255 if it has, without leading zeros, fewer than three digits or is small enough.
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        n = F.length(_digits(value))
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _placed(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """Array of (s, e, v) of the matches that ``keep`` accepts; positions are code points, end exclusive."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["g"])
        end = begin + F.length(x["v"])
        # Only what is kept lengthens the array: a rejected match costs no copy of it.
        grown = F.concat(a["out"], F.array(F.struct(begin.alias("s"), end.alias("e"), x["v"].alias("v"))))
        return F.struct(end.alias("at"), F.when(keep(x["v"]), grown).otherwise(a["out"]).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("v"))
    return F.aggregate(pairs, start, add, lambda a: a["out"])


def _base(text: Column, number: int, kind: str) -> Column:
    def keep(v: Column) -> Column:
        return _valid(kind, v)

    def shape(m: Column) -> Column:
        return F.struct(m["s"].alias("s"), F.lit(number).alias("k"), m["e"].alias("e"), m["v"].alias("v"))

    # Positions are worked out only where a match is valid.
    some = F.exists(F.regexp_extract_all(text, F.lit(KINDS[kind]), 0), keep)
    if _HINT[kind]:
        some = F.contains(text, F.lit(_HINT[kind])) & some
    none = F.array().cast("array<struct<s:int,k:int,e:int,v:string>>")
    return F.when(some, F.transform(_placed(text, KINDS[kind], keep), shape)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Array of (s, k, e, v): valid base spans by start, then kind; k is the kind's number."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*(_base(text, i, kind) for i, kind in enumerate(KINDS))))


def term_of(word: Column) -> Column:
    """The term that a word (lower-cased) stands for: itself, or its shape if it has digits."""
    letters = F.when(word.rlike(r"[^0-9]"), "a").otherwise("")
    return F.when(word.rlike("[0-9]"), F.concat(F.lit("#"), letters, F.lit("9:"), F.floor(F.log2(F.length(word))).cast("string"))).otherwise(word)


def _cut(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """``text`` with each of its spans (s, e, ...; in order of s) replaced by ``put(span)``; of overlapping ones the later is ignored."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, m: F.when(m["s"] < a["at"], a).otherwise(
            F.struct(m["e"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, F.greatest(m["s"] - a["at"], F.lit(0))), put(m))).alias("out"))
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))),
    )


def _contexts(rows: DataFrame, base: DataFrame, concepts: tuple[str, ...], reach: int) -> DataFrame:
    """place, term, classes: the words near an entity, with the sorted numbers of the classes they are near."""
    word_of = F.array(*(F.lit(c) for c in concepts)) if concepts else F.array().cast("array<string>")
    named = F.lower("text").rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(concepts) + r")(?![\p{L}\p{N}])") if concepts else F.lit(False)
    some = base.where("size(spans) > 0").select("doc_id", "copy", "spans").distinct()
    held = rows.join(bounded(shared.materialise(some)), ["doc_id", "copy"], "left").where(F.col("spans").isNotNull() | named)
    plain = F.translate("text", _MARKS, " " * len(_MARKS))
    marked = F.when(F.col("spans").isNull(), plain).otherwise(_cut(plain, F.col("spans"), lambda m: F.concat(F.lit(" "), F.substring(F.lit(_MARKS), m["k"] + 1, F.lit(1)), F.lit(" "))))
    # A row of one id and text counts once for every time it is there.
    held = shared.stored(held.select(F.monotonically_increasing_id().alias("row"), marked.alias("text")), "held")
    listed = held.select("row", F.posexplode(F.filter(F.split(F.lower("text"), rf"[^\p{{L}}\p{{N}}{_MARKS}]+"), lambda w: w != "")).alias("pos", "word"))
    kind = F.instr(F.lit(_MARKS), F.col("word")) - 1
    listed = listed.withColumn("class", F.when(kind >= 0, kind).when(F.array_contains(word_of, F.col("word")), F.lit(CREDENTIAL)))
    near = listed.where("class is not null").select("row", "class", F.explode(F.sequence(F.col("pos") - reach, F.col("pos") + reach)).alias("pos")).distinct()
    # Both sides are as many as there are words near entities, and meet by document and place.
    return listed.where("class is null").drop("class").join(near, ["row", "pos"]).select(term_of(F.col("word")).alias("term"), "class")


def disclosing_terms(rows: DataFrame, base: DataFrame, concepts: tuple[str, ...], reach: int, smoothing: float, generalise_at: float, remove_at: float) -> DataFrame:
    """term, degree, action ("remove" or "generalise"): terms that disclose a protected class.

    ``rows``: doc_id, copy, text. ``base``: doc_id, copy, spans.
    """
    both = shared.materialise(_contexts(rows, base, concepts, reach).groupBy("class", "term").agg(F.count("*").alias("nct")))
    words = F.filter(F.split(F.lower("text"), GAP), lambda w: w != "")
    total = rows.agg(F.sum(F.size(words).cast("long"))).first()[0] or 0 if not both.isEmpty() else 0
    size = both.groupBy("class").agg(F.sum("nct").alias("nc"))
    n = F.lit(float(max(total, 1)))
    rate = F.least(F.col("nc") / n, F.lit(1.0))
    # The most that a term can reach is what it would if it stood nowhere else.
    degree = lambda nt: F.when(rate < 1, F.log((F.col("nct") + F.lit(smoothing) * rate) / (nt + F.lit(smoothing)) / rate) / -F.log(rate)).otherwise(F.lit(0.0))
    able = shared.materialise(both.join(F.broadcast(size), "class").where(degree(F.col("nct")) >= generalise_at))
    wanted = bounded(shared.materialise(able.select("term").distinct()))
    counts = rows.select(F.explode(words).alias("word")).select(term_of(F.col("word")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("nt"))
    # A place counts once for a term, but a word beside a base span may be cut differently there.
    found = able.join(counts, "term", "left").withColumn("degree", degree(F.greatest(F.coalesce("nt", F.lit(0)), F.col("nct"))))
    return found.groupBy("term").agg(F.max("degree").alias("degree")).where(F.col("degree") >= generalise_at).withColumn("action", F.when(F.col("degree") >= remove_at, "remove").otherwise("generalise"))


def find(docs: DataFrame, concepts: tuple[str, ...] = CONCEPTS, reach: int = 2, smoothing: float = 8.0, generalise_at: float = 0.9, remove_at: float = 0.97) -> DataFrame:
    """doc_id, copy, base, terms: base spans (s, k, e, v) and term spans (s, e, a) of every document.

    ``copy`` is a hash of the text, which tells rows of one id apart. Null and empty texts have no
    spans. Terms that touch a base span are not reported again. Repeated rows come out repeatedly and
    count repeatedly, but a text that other ids share counts for one id; an empty table gives an empty result; further columns and rows without an id are
    ignored. Counts are taken over all texts. A very long text is laid out as rows of words; only where
    it has spans are they held as one array. Of equal degrees all terms are taken.
    """
    rows = shared.id_text(docs).withColumn("copy", F.xxhash64("text"))
    base = shared.stored(rows.select("doc_id", "copy", base_spans(F.col("text")).alias("spans")), "base")
    # Copies of a text under other ids say nothing new: only the smallest id's rows are counted.
    held = base.select("doc_id", "copy").distinct()
    others = held.join(held.groupBy("copy").agg(F.min("doc_id").alias("first")), "copy").where("doc_id <> first").select("doc_id", "copy")
    own = rows.join(bounded(shared.materialise(others)), ["doc_id", "copy"], "left_anti")
    terms = shared.materialise(disclosing_terms(own, base, concepts, reach, smoothing, generalise_at, remove_at))
    none = F.array().cast("array<struct<s:int,e:int,a:string>>")
    if terms.isEmpty():
        return base.select("doc_id", "copy", F.col("spans").alias("base"), none.alias("terms"))
    listed = rows.select("doc_id", "copy", F.explode(F.array_distinct(F.split(F.lower("text"), GAP))).alias("word")).where("word <> ''")
    hit = listed.withColumn("term", term_of(F.col("word"))).join(bounded(terms.select("term", "action")), "term").select("doc_id", "copy", "word", "action").distinct()
    # A word has one term, so the entries of a text have different keys.
    hits = shared.materialise(hit.groupBy("doc_id", "copy").agg(F.map_from_entries(F.collect_list(F.struct("word", "action"))).alias("actions")))
    places = F.transform(
        _placed(F.col("text"), TERM, lambda v: F.map_contains_key("actions", F.lower(v))),
        lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.try_element_at("actions", F.lower(m["v"])).alias("a")),
    )
    # Places of the terms, in the documents that have one.
    found = shared.stored(rows.join(bounded(hits), ["doc_id", "copy"]).select("doc_id", "copy", places.alias("t")).dropDuplicates(["doc_id", "copy"]), "terms")
    both = base.join(bounded(found), ["doc_id", "copy"], "left").select("doc_id", "copy", F.col("spans").alias("base"), F.coalesce("t", none).alias("t"))
    apart = F.filter("t", lambda m: ~F.exists("base", lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])))
    return both.select("doc_id", "copy", "base", apart.alias("terms"))


def _kind_name(k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n in KINDS)), k + 1)


def _listed(spans: Column, name) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", name(m), m["s"].cast("string"), m["e"].cast("string"))), ",")


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """All columns of ``docs``, with the spans of ``found`` taken out of the text.

    Base spans become their kind in brackets, generalised terms "[TERM]", removed terms nothing.
    Of overlapping spans the later one is left out. Rows without an id stay as they are.
    """
    mark, key = "_spans", "_copy"
    while {mark, key} & set(docs.columns):
        mark, key = f"_{mark}", f"_{key}"
    spans = F.concat(
        F.transform("base", lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.concat(F.lit("["), F.upper(_kind_name(m["k"])), F.lit("]")).alias("r"))),
        F.transform("terms", lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.when(m["a"] == "remove", F.lit("")).otherwise(F.lit("[TERM]")).alias("r"))),
    )
    changed = found.where("size(base) > 0 or size(terms) > 0").select("doc_id", F.col("copy").alias(key), F.array_sort(spans).alias(mark)).distinct()
    cut = _cut(F.col("text"), F.col(mark), lambda m: m["r"])
    columns = [F.when(F.col(mark).isNull(), F.col("text")).otherwise(cut).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return rows.join(bounded(shared.materialise(changed)), ["doc_id", key], "left").select(*columns)


def op3_disclosure_sanitiser(spark, sf_dir: str) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every document."""
    found = find(shared.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda m: m["k"] == k)).cast("long")
    base = F.transform("base", lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["e"].alias("e"), _kind_name(m["k"]).alias("n")))
    extra = F.transform("terms", lambda m: F.struct(m["s"].alias("s"), F.lit(9).alias("k"), m["e"].alias("e"), F.lit("term").alias("n")))
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)),
        F.sha2(_listed(base, lambda m: m["n"]), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat(base, extra)), lambda m: m["n"]).alias("spans"),
    )
