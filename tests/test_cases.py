"""Literal cases, results under other partitionings, and refusals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliant.functions import numbers
from foliant.functions.text import human_size, natural_key
from foliant.operators import aggregates as A
from foliant.operators import isolate, joins, project, sequence
from foliant.sources import files

from . import plain_numbers


@pytest.mark.parametrize(
    ("spec", "count", "pages", "error"),
    [
        ("", 3, [1, 2, 3], None),
        ("1-3,5,8-", 9, [1, 2, 3, 5, 8, 9], None),
        ("-3", 5, [1, 2, 3], None),
        ("3,1,3", 5, [3, 1], None),
        ("1–2；4", 5, [1, 2, 4], None),
        ("0", 5, [], "pages count from 1"),
        ("4-2", 5, [], "first page after last: 4-2"),
        ("2-9", 5, [], "no page 9 of 5"),
        ("x", 5, [], "not a page number: x"),
        (",", 5, [], "nothing selected"),
        ("9,x", 5, [], "not a page number: x"),
        ("6-", 5, [], "no page 6 of 5"),
    ],
)
def test_page_ranges(spark, spec, count, pages, error):
    df = spark.createDataFrame([(1, spec, count)], "req long, spec string, page_count int")
    rows = sorted(project.expand_page_ranges(df).collect(), key=lambda r: r.pos or 0)
    assert [r.page for r in rows if r.page is not None] == pages
    assert {r.error for r in rows} <= {error}


@pytest.mark.parametrize(
    ("text", "shown", "offset"),
    [
        ("2024-03-15", "2024-03-15 00:00:00", None),
        ("2024-03-15T14:30", "2024-03-15 14:30:00", None),
        ("2024-03-15T14:30:22.123Z", "2024-03-15 14:30:22", 0),
        ("2024-03-15T14:30:22+08:00", "2024-03-15 14:30:22", 480),
        ("2024-03-15T14:30:22-0330", "2024-03-15 14:30:22", -210),
        ("2024-02-31T23:59:60+08", "2024-02-31 23:59:60", 480),
        ("0000-00-00T00:00:00", None, None),
        ("2024-13-01", None, None),
        ("2024-03-15T14", None, None),
        ("2024-03-15T14:30+15:00", None, None),
        (None, None, None),
    ],
)
def test_iso_times(spark, text, shown, offset):
    t = joins.parse_iso8601(F.col("t"))
    row = spark.createDataFrame([(text,)], "t string").select(joins.show_time(t).alias("s"), t["offset_min"].alias("o")).first()
    assert (row.s, row.o) == (shown, offset)


def test_natural_order(spark):
    names = ["a10.jpg", "a2.jpg", "A1.jpg", "10", "2", "b", "a2b", "a99999999999999999999999", "a"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(natural_key(F.col("n")), "n").collect()] == ["a", "A1.jpg", "a2.jpg", "a2b", "a10.jpg", "a99999999999999999999999", "b", "2", "10"]


def test_number_columns_equal_plain_texts(spark):
    import random

    rng = random.Random(7)
    formats = ["decimal", "decimalHalfWidth", "none", "bullet", "decimalZero", "decimalFullWidth", "upperRoman", "lowerRoman", "upperLetter", "lowerLetter", "ordinal", "cardinalText", "ordinalText", "hex", "arabicDash", *numbers.CIRCLED, "decimalEnclosedParen", "decimalEnclosedFullstop", *numbers.COUNTED, "chineseLegalSimplified", "ideographLegalTraditional", "ideographTraditional", "ideographZodiac", "unheard"]
    own = [*range(-3, 131), *(10**k + d for k in range(3, 10) for d in (-1, 0, 1, 10, 100)), 2**31 - 1, 10_010, 100_110_000, 20_000_012, *(rng.randrange(10 ** rng.randint(3, 9)) for _ in range(150))]
    own = [n for n in own if n < 2**31]
    few = [n for n in own if n < 100_000]  # letters and thousands are repeated
    long = {"upperRoman", "lowerRoman", "upperLetter", "lowerLetter"}
    rows = {fmt: few if fmt in long else own for fmt in formats}
    df = spark.createDataFrame([(fmt, mine, [fmt] * len(mine)) for fmt, mine in rows.items()], "fmt string, n array<int>, f array<string>")
    found = {r.fmt: r.t for r in df.select("fmt", numbers.number_texts(F.col("f"), F.col("n")).alias("t")).collect()}
    for fmt, mine in rows.items():
        assert found[fmt] == [plain_numbers.number_text(n, fmt) for n in mine], fmt


def test_number_texts(spark):
    t = plain_numbers.number_text
    of = lambda fmt, *n: [t(k, fmt) for k in n]
    assert of("upperRoman", 4, 9, 14, 40, 90, 400, 1994, 0) == ["IV", "IX", "XIV", "XL", "XC", "CD", "MCMXCIV", "0"]
    assert of("lowerLetter", 1, 26, 27, 53, 120) == ["a", "z", "aa", "aaa", "ppppp"]
    assert of("ordinal", 1, 2, 3, 11, 22, 113) == ["1st", "2nd", "3rd", "11th", "22nd", "113th"]
    assert of("chineseCounting", 0, 5, 10, 11, 20, 101, 110, 120) == ["〇", "五", "十", "十一", "二十", "一百零一", "一百一十", "一百二十"]
    assert of("japaneseCounting", 1001, 1010, 10001, 11000, 110000) == ["一千零一", "一千零一十", "一万零一", "一万一千", "十一万"]
    assert of("chineseLegalSimplified", 10, 11, 101, 120) == ["壹拾", "壹拾壹", "壹佰零壹", "壹佰贰拾"]
    assert of("ideographLegalTraditional", 2, 3, 106, 10001) == ["貳", "參", "壹佰零陸", "壹萬零壹"]
    assert of("ideographTraditional", 10, 11) == ["癸", "11"] and of("ideographZodiac", 12, 13) == ["亥", "13"]
    assert of("ordinalText", 1, 12, 20, 21, 100, 101, 120) == ["First", "Twelfth", "Twentieth", "Twenty-first", "One hundredth", "One hundred first", "One hundred twentieth"]
    assert of("cardinalText", 13, 40, 99, 100, 119) == ["Thirteen", "Forty", "Ninety-nine", "One hundred", "One hundred nineteen"]
    assert of("decimalEnclosedCircle", 1, 20, 21, 35, 36, 50, 51) == ["①", "⑳", "㉑", "㉟", "㊱", "㊿", "51"] and of("ideographEnclosedCircle", 2) == ["②"]
    assert of("decimalEnclosedParen", 3, 21) == ["⑶", "21"] and of("decimalZero", 9, 10, 100) == ["09", "10", "100"] and of("decimalHalfWidth", 7) == ["7"]
    assert t(3, "unheard") is None and t(3, "bullet") == ""
    row = spark.range(1).select(numbers.number_texts(F.array(F.lit("upperRoman"), F.lit("unheard"), F.lit("decimal")), F.array(F.lit(5000), F.lit(1), F.lit(None).cast("int"))).alias("t")).first()
    assert row.t == ["MMMMM", None, None]


def test_numbering_sequence(spark):
    """Levels restart below a higher item; an override counts once; restart 0 never resets."""
    levels = spark.createDataFrame([(1, 0, 1, "decimal", "%1.", None, False), (1, 1, 1, "lowerLetter", "%1.%2", None, False), (1, 2, 1, "lowerRoman", "%3)", 0, False)], "abs int, ilvl int, start int, fmt string, lvl_text string, restart int, legal boolean")
    over = spark.createDataFrame([(2, 0, 7)], "num_id int, ilvl int, start int")
    seq = [(1, 0), (1, 1), (1, 1), (1, 2), (1, 0), (1, 1), (1, 2), (2, 0), (1, 0), (2, 0), (0, 0), (1, 9), (2, 1)]
    items = spark.createDataFrame([(1, i, n, k, 1) for i, (n, k) in enumerate(seq)], "doc_id long, ord int, num_id int, ilvl int, abs int")
    numbered = sequence.number_items(items, levels, over)
    labels = sequence.expand_labels(numbered, levels).orderBy("ord").collect()
    assert [r.label for r in labels] == ["1.", "1.a", "1.b", "i)", "2.", "2.a", "ii)", "7.", "8.", "9.", "9.a"]
    assert not any(r.fallback for r in labels)


def test_output_names_avoid_everything(spark):
    wanted = spark.createDataFrame([(1, "d", "a", "pdf"), (2, "d", "a", "pdf"), (3, "d", "a", "pdf"), (4, "e", "a", "pdf"), (5, "d", "b", "")], "ord long, dir string, stem string, ext string")
    taken = spark.createDataFrame([("d", "a (2).pdf"), ("d", "a.txt"), ("d", "b"), ("d", "a (4).pdf")], "dir string, name string")
    found = {r.ord: r.output for r in files.assign_output_names(wanted, taken).collect()}
    assert found == {1: "a.pdf", 2: "a (3).pdf", 3: "a (5).pdf", 4: "a.pdf", 5: "b (2)"}


def brute_names(requests, occupied):
    used = set(occupied)
    out = {}
    for k, d, stem, ext in sorted(requests):
        n = 1
        while (name := (stem if n == 1 else f"{stem} ({n})") + (f".{ext}" if ext else "")) in {x for f, x in used if f == d}:
            n += 1
        used.add((d, name))
        out[k] = name
    return out


def test_output_names_are_compared_literally(spark):
    import random

    rng = random.Random(3)
    stems = ["a", "a (2)", "a (2) (2)", "a (3)", "b", "b (02)", "c", "c (9)x", "d.e"]
    for exts in (["pdf", "txt"], [""]):
        requests = [(k, rng.choice("xy"), rng.choice(stems), rng.choice(exts)) for k in range(80)]
        occupied = [(rng.choice("xy"), rng.choice(stems) + rng.choice(["", " (2)", " (4)", " (10)"]) + rng.choice([".pdf", ".txt", ""])) for _ in range(30)]
        wanted = spark.createDataFrame(requests, "ord long, dir string, stem string, ext string")
        found = {r.ord: r.output for r in files.assign_output_names(wanted, spark.createDataFrame(occupied, "dir string, name string")).collect()}
        assert found == brute_names(requests, occupied)


def test_names_of_stems_that_meet_each_others_numbers(spark):
    import random

    for seed in range(4):
        rng = random.Random(seed)
        stems = ["a", *(f"a ({n})" for n in range(1, 12)), "a (3) (2)", "a (3) (2) (4)", "a (2) (2)", "a (02)", "a (2) "]
        requests = [(k, "x", rng.choice(stems[:1] * 12 + stems), "pdf") for k in rng.sample(range(500), 120)]
        occupied = [("x", f"{rng.choice(stems)}.pdf") for _ in range(rng.randrange(5))] + [("x", "a (14).pdf"), ("x", "a (3) (2) (2).pdf")]
        wanted = spark.createDataFrame(requests, "ord long, dir string, stem string, ext string")
        found = {r.ord: r.output for r in files.assign_output_names(wanted, spark.createDataFrame(occupied, "dir string, name string")).collect()}
        assert found == brute_names(requests, occupied)


def test_write_guarded_refuses(spark, tmp_path):
    df = spark.range(3)
    path = f"file://{tmp_path}/out"
    with pytest.raises(ValueError, match="inputs"):
        files.write_guarded(df, path, [str(tmp_path / "out")])
    (tmp_path / "link").symlink_to(tmp_path)
    for same in (f"{tmp_path}/x/../out", f"{tmp_path}/link/out", f"file://{tmp_path}/out/"):
        with pytest.raises(ValueError, match="inputs"):
            files.write_guarded(df, path, [same])
    files.write_guarded(df, path, [])
    with pytest.raises(Exception, match="exists"):
        files.write_guarded(df, path, [])


def test_scan_skips_hidden_and_deep(spark, tmp_path):
    deep = "1/2/3/4/5/6/7/8/"
    for p in ("a2.txt", "a10.txt", ".hidden/x.txt", "d/.y", "d/e/f.txt", f"{deep}9/deep.txt", f"{deep}ok.txt", "_a.pdf", "_b/c.txt", "_b/_g/_h.txt", "d/_i.txt", f"{deep}_j.txt", f"{deep}9/_deep.txt", "_b/.z"):
        (tmp_path / "r+1" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r+1" / p).write_text("x")
    root = f"file://{tmp_path}/r+1"
    found = files.scan_files(spark, root).collect()
    names = [r.name for r in found]
    assert sorted(names) == ["_a.pdf", "_h.txt", "_i.txt", "_j.txt", "a10.txt", "a2.txt", "c.txt", "f.txt", "ok.txt"] and names.index("a2.txt") < names.index("a10.txt")
    assert {r.name: r.depth for r in found} == {"_a.pdf": 0, "_h.txt": 2, "_i.txt": 1, "_j.txt": 8, "a10.txt": 0, "a2.txt": 0, "c.txt": 1, "f.txt": 2, "ok.txt": 8} and {r.length for r in found} == {1}
    assert files.scan_files(spark, root, limit=2).count() == 2
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "t.txt").write_text("x")
    assert files.scan_files(spark, [root, f"file://{tmp_path}/s"]).count() == 10


def test_batch_summary_by_input_order(spark):
    rows = [("b", 1, "o1", None, 100, 50), ("b", 2, None, "bad 2", 10, 10), ("b", 0, None, "bad 0", 10, 10), ("b", 3, "o3", None, 100, 70), ("c", 1, None, "x", 1, 1)]
    found = {r.batch: r for r in A.batch_summary(spark.createDataFrame(rows, "batch string, ord long, output string, error string, before long, after long")).collect()}
    b = found["b"]
    assert (b.succeeded, b.failed, b.last_output, b.first_error, b.before, b.after, b.saved_ratio, b.batch_failed) == (2, 2, "o3", "bad 0", 200, 120, 0.4, False)
    assert found["c"].batch_failed and found["c"].saved_ratio == 0


def pages_of(spark, rows, capacity, **rules):
    df = spark.createDataFrame(rows, "doc long, para long, line long, height double").withColumns({k: F.lit(v) for k, v in rules.items()})
    return [r.page for r in sequence.pack_pages(df, capacity).orderBy("para", "line").collect()]


def test_pages_widows_orphans_and_chains(spark):
    para = lambda p, n: [(1, p, i, 10.0) for i in range(n)]
    assert pages_of(spark, para(0, 5), 40.0) == [0, 0, 0, 0, 1]
    assert pages_of(spark, para(0, 5), 40.0, widow_control=True) == [0, 0, 0, 1, 1]
    assert pages_of(spark, para(0, 3) + para(1, 3), 40.0, widow_control=True) == [0, 0, 0, 1, 1, 1]
    assert pages_of(spark, para(0, 3) + para(1, 2), 40.0, keep_lines=True) == [0, 0, 0, 1, 1]
    assert pages_of(spark, para(0, 2), 5.0) == [0, 1]
    assert pages_of(spark, para(0, 4), 100.0, break_after=True) == [0, 1, 2, 3]
    # Six lines of which five fit; of three of which two fit the whole paragraph goes on.
    assert pages_of(spark, para(0, 6), 50.0, widow_control=True) == [0, 0, 0, 0, 1, 1]
    assert pages_of(spark, para(0, 2) + para(1, 3), 40.0, widow_control=True) == [0, 0, 1, 1, 1]
    assert pages_of(spark, [(1, 0, 0, 60.0), (1, 0, 1, 10.0)], 40.0) == [0, 1]


def test_no_space_after_a_break(spark):
    """Three lines of ten with eight after them; the first ends its page and leaves nothing on the next."""
    rows = [(1, p, 0, 10.0, p == 0, 8.0) for p in range(3)]
    df = spark.createDataFrame(rows, "doc long, para long, line long, height double, break_after boolean, space_after double")
    assert [r.page for r in sequence.pack_pages(df, 30.0).orderBy("para").collect()] == [0, 1, 1]
    assert [r.page for r in sequence.pack_pages(df.withColumn("space_before", F.lit(3.0)), 30.0).orderBy("para").collect()] == [0, 1, 2]


def test_a_moved_paragraph_drops_its_gap_and_chains_stay_together(spark):
    rows = [(1, p, i, 10.0) for p, n in ((0, 3), (1, 1), (2, 1), (3, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc long, para long, line long, height double")
    chained = df.withColumn("keep_next", F.col("para").isin(1, 2))
    assert [r.page for r in sequence.pack_pages(chained, 55.0).orderBy("para", "line").collect()] == [0, 0, 0, 1, 1, 1, 1, 1, 2]
    gaps = df.withColumn("keep_lines", F.lit(True)).withColumn("space_before", F.lit(12.0))
    assert [r.page for r in sequence.pack_pages(gaps, 44.0).orderBy("para", "line").collect()] == [0, 0, 0, 1, 1, 2, 2, 2, 2]


def runs_of(spark, text, mode="context"):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.start, r.end, r["class"]) for r in sequence.script_runs(df, mode).orderBy("start").collect()]


def classes(spark, text):
    return "".join(("E" if c == "east_asian" else "L") * (b - a) for a, b, c in runs_of(spark, text))


def test_script_runs_follow_the_context(spark):
    assert runs_of(spark, "“中 a”b ") == [(0, 1, "latin"), (1, 3, "east_asian"), (3, 7, "latin")]
    assert runs_of(spark, "“中 a”b ", "both") == [(0, 3, "east_asian"), (3, 7, "latin")]
    for text, expected in (("中“文”", "EEEE"), ("AB“C", "LLLL"), ("25℃，", "LLLE"), ("中——文", "EEEE"), ("□选", "LE"), ("中×文", "ELE"), ("中α文", "ELE"), ("第Ⅱ部", "EEE"), ("中\u2126", "EE"), ("中\u03a9", "EL"), ("100㎡", "LLLE"), ("中عربي", "ELLLL"), ("中ไทย", "ELLL"), ("𠀀“a", "EEL"), ("中\n\ue000", "EEE")):
        assert classes(spark, text) == expected, text
    assert runs_of(spark, "“ ”", "both") == [(0, 3, "latin")] and runs_of(spark, "") == []
    assert runs_of(spark, "中" * 30_000 + "a" * 30_000) == [(0, 30_000, "east_asian"), (30_000, 60_000, "latin")]


def test_a_hint_turns_ambiguous_characters(spark):
    spans = spark.createDataFrame([(1, 0, "AB“C”×é α 1", True), (2, 0, "“", True), (2, 1, "A“", False), (3, 0, "é“", None)], "doc_id long, ord int, text string, hint boolean")
    found = {}
    for r in sequence.script_runs(sequence.hinted_text(spans)).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.end, r["class"][0]))
    assert sorted(found[1]) == [(0, 2, "l"), (2, 3, "e"), (3, 4, "l"), (4, 6, "e"), (6, 8, "l"), (8, 10, "e"), (10, 11, "l")]
    assert sorted(found[2]) == [(0, 1, "e"), (1, 3, "l")] and sorted(found[3]) == [(0, 2, "l")]


def test_coverage_of_marks_and_controls(spark):
    texts = spark.createDataFrame([(1, "a\u0301\u0301b?\n\u0301中"), (2, "\u0301a"), (3, "")], "doc_id long, text string")
    coverage = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), ("中", 2)], "ch string, dict int")
    found = [(r.doc_id, r.start, r.end, r.dict, r.missing) for r in joins.coverage_split(texts, coverage).orderBy("doc_id", "start").collect()]
    assert found == [(1, 0, 4, 1, False), (1, 4, 5, 1, True), (1, 5, 6, 1, True), (1, 6, 7, 1, False), (1, 7, 8, 2, False), (2, 0, 2, 1, False)]
    long = spark.createDataFrame([(1, "a" * 40_000 + "e\u0301" * 40_000 + "b" + "\u0301" * 40_000)], "doc_id long, text string")
    assert [(r.start, r.end, r.missing) for r in joins.coverage_split(long, coverage).orderBy("start").collect()] == [(0, 40_000, False), (40_000, 120_000, True), (120_000, 160_001, False)]


def test_lookups_go_through_the_lists(spark):
    requests = spark.createDataFrame([(1, "x", "sans"), (2, "n-b", "sans"), (3, "q", "serif"), (4, "q", "mono"), (5, "n", "mono")], "req long, want string, category string")
    catalog = spark.createDataFrame([("n", 9, "sans"), ("m", 1, "sans"), ("k", 2, "serif")], "name string, pref long, category string")
    chains = spark.createDataFrame([("sans", 1, "gone"), ("sans", 2, "n"), ("serif", 5, "k")], "category string, place int, name string")
    found = lambda *a: {r.req: (r.found, r.rank) for r in joins.ranked_lookup(requests, catalog, *a).collect()}
    assert found(chains) == {1: ("n", 3), 2: ("n", 2), 3: ("k", 3), 4: ("n", 4), 5: ("n", 1)}
    assert found(chains.limit(0)) == {1: ("m", 5), 2: ("n", 2), 3: ("m", 5), 4: ("m", 5), 5: ("n", 1)}
    assert found()[1] == ("m", 3)


def test_capture_time_of_several_columns(spark):
    rows = [(1, None, "2024-01-02", "2023-05-05", "2023-04-04"), (2, "bad", None, "2023-05-05", "2023-06-06"), (3, None, None, None, "2023-06-06"), (4, "2020-01-01", "2019-01-01", None, None), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "file long, original string, digitised string, created string, modified string")
    found = joins.resolve_capture_time(df, [("exif", ["original", "digitised"])], ["created", "modified"])
    shown = {r.file: (r.s, r.source, r.is_capture_time) for r in found.withColumn("s", joins.show_time(F.col("when"))).collect()}
    day = lambda d: f"{d} 00:00:00"
    assert shown == {1: (day("2024-01-02"), "exif", True), 2: (day("2023-05-05"), "file", False), 3: (day("2023-06-06"), "file", False), 4: (day("2020-01-01"), "exif", True), 5: (None, None, False)}


def test_places_of_a_global_order(spark):
    df = spark.createDataFrame([(i, f"f{(i * 7919) % 500}") for i in range(500)], "ord long, name string").repartition(9)
    found = sorted(project.natural_sort(df, "name", "ord").collect(), key=lambda r: r.place)
    assert [r.place for r in found] == list(range(1, 501)) and [r.name for r in found] == [f"f{i}" for i in range(500)]
    assert project.natural_sort(df.limit(0), "name", "ord").count() == 0


def test_sequences_match_greedily(spark):
    schema = "doc long, line int, text string, page int, x double, y double"
    ours = spark.createDataFrame([(1, i, t, p, 1.0, float(i)) for i, (t, p) in enumerate((("aa", 0), ("bb", 0), ("aa", 0), ("cc", 1), ("x", 1)))], schema)
    ref = spark.createDataFrame([(1, i, t, p, 3.0, float(i)) for i, (t, p) in enumerate((("bb", 0), ("aa", 1), ("aa", 1), ("cc", 1), ("x", 1)))], schema)
    found = sorted((r.line_ref, r.line_ours, r.same_page, r.dx, r.dy) for r in joins.match_sequences(ours, ref).collect())
    assert found == [(0, 1, True, 2.0, 1.0), (1, 2, False, None, None), (3, 3, True, 2.0, 0.0)]
    assert [(r.line_ref, r.line_ours) for r in joins.match_sequences(ours.drop("page", "x", "y"), ref, 1).collect()] == [(1, 0)]


def test_cycles_and_missing_parents_end(spark):
    nodes = spark.createDataFrame([("a", "b", None), ("b", "a", 5), ("c", "a", None), ("d", "zz", None), ("e", "e", 1), ("f", None, None)], "id string, parent string, v int")
    found = {r.id: r.v for r in joins.inherit_attributes(nodes, ["v"]).collect()}
    assert found == {"a": 5, "b": 5, "c": 5, "d": None, "e": 1, "f": None}


def test_isolated_failures(spark):
    df = spark.createDataFrame([(i, i) for i in range(5)], "ord long, n int")

    def fn(row):
        return str(10 // (row["n"] - 2)), "fine"

    found = {r.ord: (r.output, r.error) for r in isolate.map_isolated(df, fn).collect()}
    assert found[2][0] is None and "ZeroDivisionError" in found[2][1] and found[3] == ("10", None)
    typed = isolate.map_isolated(df, lambda row: (10 // (row["n"] - 2), row["n"] / 2, "x"), "value long, half double, name string")
    assert {r.ord: (r.value, r.half, r.name) for r in typed.collect()}[4] == (5, 2.0, "x") and typed.columns == ["ord", "value", "half", "name", "error"]
    assert {r.ord for r in typed.where("error is not null").collect()} == {2}


def test_no_picks_is_an_error(spark):
    picks = spark.createDataFrame([], "pick_no long, source string, page int, rotate int")
    pages = spark.createDataFrame([("s", 0, 90)], "source string, page int, rotate int")
    assert [tuple(r) for r in joins.assemble_pages(picks, pages).collect()] == [(None, None, None, None, "no picks")]
    one = spark.createDataFrame([(1, "s", 0, 450)], picks.schema)
    assert [tuple(r) for r in joins.assemble_pages(one, pages).collect()] == [(1, "s", 0, 180, None)]


def test_objects_are_numbered_as_they_are_found(spark):
    edges = spark.createDataFrame([("a", "z", 1), ("a", "m", 2), ("z", "q", 1), ("m", "b", 1), ("q", "a", 1), ("b", "z", 1), ("m", "stop", 0)], "src string, dst string, ord int")
    found = {r.id: (r.depth, r.new_id) for r in joins.reachable_objects(edges, spark.createDataFrame([("a",)], "id string"), F.col("id") == "stop").collect()}
    assert found == {"a": (0, 0), "z": (1, 1), "m": (1, 2), "q": (2, 3), "b": (2, 4)}


def test_a_layer_that_sets_one_indent_unsets_the_other(spark):
    styles = spark.createDataFrame([(1, None, 10.0, None), (2, 1, None, 4.0), (3, 2, None, None)], "id long, based_on long, first_line double, hanging double")
    items = spark.createDataFrame([(1, 1, None, None, 9.0), (2, 2, None, None, 9.0), (3, 3, None, 1.0, None), (4, 99, None, None, 9.0), (5, 99, None, None, None)], "ord long, style long, char_style long, d_first_line double, t_hanging double")
    found = joins.resolve_cascade(items, styles, ["first_line", "hanging"], [], {"first_line": 0.5}, [("first_line", "hanging")]).orderBy("ord").collect()
    assert [(r.first_line, r.hanging) for r in found] == [(10.0, None), (None, 4.0), (1.0, None), (None, 9.0), (0.5, None)]


def test_relations_of_parts(spark):
    refs = spark.createDataFrame([(1, 7, "picture", "body"), (2, 7, "picture", "header"), (3, 8, "link", "body")], "ref long, rel_id long, kind string, part string")
    rels = spark.createDataFrame([(7, "a", False, "body"), (7, "b", False, "header"), (8, "c", True, "header")], "rel_id long, target string, external boolean, part string")
    assert sorted(tuple(r) for r in joins.resolve_relationships(refs, rels).collect()) == [(1, "picture", "a"), (2, "picture", "b"), (3, "link", None)]
    assert sorted(r.target for r in joins.resolve_relationships(refs, rels.where("part = 'header'").drop("part")).collect()) == ["b", "b", "c"]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from foliant import storage

    unset = SimpleNamespace(get=lambda key, default=None: default)
    session = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://head:7077", getConf=lambda: unset))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(session)


def test_sizes(spark):
    row = spark.createDataFrame([(1023, 1536, 3 * 1024**2)], "a long, b long, c long").select(*(human_size(F.col(c)).alias(c) for c in "abc")).first()
    assert tuple(row) == ("1023 B", "1.5 KB", "3.0 MB")


@pytest.mark.parametrize("name", ["w1_number_items", "w3_script_runs", "w8_pack_pages_rules", "j10_match_sequences", "j15_asof_next", "s4_assign_output_names"])
def test_partitioning_does_not_matter(spark, sf_dir, name, monkeypatch):
    from foliant import adapters, plans

    def result():
        return sorted(map(str, plans.queries()[name](spark, sf_dir).collect()))

    expected = result()
    plain = adapters.table
    monkeypatch.setattr(adapters, "table", lambda s, d, n: plain(s, d, n).orderBy(F.rand(3)).repartition(7))
    assert result() == expected


def test_page_starts_are_found_in_other_texts(spark):
    rows = lambda texts, per: [(1, i // per, i, t) for i, t in enumerate(texts)]
    schema = "doc long, page int, line int, text string"
    lines = [f"{i:02d} begins a line" for i in range(12)]
    ours = spark.createDataFrame(rows(["changed", *lines[1:]], 4), schema)
    same = spark.createDataFrame(rows(lines, 4), schema)
    other = spark.createDataFrame(rows(lines, 3), schema)
    assert joins.boundary_drift(same, same).first()[1:] == (0, 0, 0)
    assert joins.boundary_drift(ours, same).first()[1:] == (0, 0, 0)
    assert joins.boundary_drift(ours, other).first()[1:] == (2, 5, 0)
