"""Number texts of list formats, for any 32-bit number, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Words and signs of the formats.
ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
ONES_ORDINAL = ["zeroth", "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth"]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
TENS_ORDINAL = ["", "", "twentieth", "thirtieth", "fortieth", "fiftieth", "sixtieth", "seventieth", "eightieth", "ninetieth"]
#: Digits 0 to 9, the zero inside a number, ten, hundred and thousand, ten thousand.
COUNTING = ("〇一二三四五六七八九", "零", "十百千", "万")
LEGAL_SIMPLIFIED = ("零壹贰叁肆伍陆柒捌玖", "零", "拾佰仟", "万")
LEGAL_TRADITIONAL = ("零壹貳參肆伍陸柒捌玖", "零", "拾佰仟", "萬")
STEMS, BRANCHES = "甲乙丙丁戊己庚辛壬癸", "子丑寅卯辰巳午未申酉戌亥"
#: First and last number and first sign of each run of enclosed numbers.
CIRCLES, PARENS, STOPS = [(1, 20, "①"), (21, 35, "㉑"), (36, 50, "㊱")], [(1, 20, "⑴")], [(1, 20, "⒈")]
#: Formats that write numbers in the same way.
CIRCLED = ["decimalEnclosedCircle", "decimalEnclosedCircleChinese", "ideographEnclosedCircle"]
COUNTED = ["chineseCounting", "chineseCountingThousand", "ideographDigital", "japaneseCounting", "taiwaneseCounting", "taiwaneseCountingThousand"]




def _pick(values: list[str] | str, at: Column) -> Column:
    """The value at a place from 0; null beyond the last."""
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def _digit(n: Column, place: int) -> Column:
    return F.floor(n / place) % 10


def roman(n: Column) -> Column:
    """Thousands by M alone; a digit below by the three signs of its place."""
    shapes = ["", "a", "aa", "aaa", "ab", "b", "ba", "baa", "baaa", "ac"]
    parts = [_pick([x.translate(str.maketrans("abc", signs)) for x in shapes], _digit(n, place)) for place, signs in ((100, "CDM"), (10, "XLC"), (1, "IVX"))]
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), *parts)


def letters(n: Column) -> Column:
    """A to Z, then AA, BB and so on."""
    return F.repeat(F.char(65 + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))


def ordinal(n: Column) -> Column:
    ending = F.when((n % 100).between(10, 20), "th").otherwise(F.coalesce(_pick(["th", "st", "nd", "rd"], n % 10), F.lit("th")))
    return F.concat(n.cast("string"), ending)


def words(n: Column, last: bool) -> Column:
    """A number in words, the first one with a capital; with ``last`` the last word is an ordinal."""

    def below(k: Column, last: bool) -> Column:
        """Under a hundred, and nothing for 0."""
        tens, one = _digit(k, 10), k % 10
        whole = _pick(TENS_ORDINAL if last else TENS, tens)
        both = F.concat_ws("-", _pick(TENS, tens), _pick(ONES_ORDINAL if last else ONES, one))
        return F.when(k == 0, F.lit(None)).when(k < 20, _pick(ONES_ORDINAL if last else ONES, k)).when(one == 0, whole).otherwise(both)

    def hundreds(k: Column) -> Column:
        return F.when(k >= 100, F.concat(_pick(ONES, F.floor(k / 100)), F.lit(" hundred")))

    def group(scale: int, name: str) -> Column:
        k = F.floor(n / scale) % 1000
        return F.when(k > 0, F.concat_ws(" ", hundreds(k), below(k % 100, False), F.lit(name)))

    rest = n % 1000
    text = F.concat_ws(" ", group(10**9, "billion"), group(10**6, "million"), group(1000, "thousand"), hundreds(rest), below(rest % 100, last))
    if last:
        text = F.when(n % 100 == 0, F.concat(text, F.lit("th"))).otherwise(text)
    text = F.when(n == 0, (ONES_ORDINAL if last else ONES)[0]).otherwise(text)
    return let(text, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1000)))


def chinese(n: Column, script: tuple[str, str, str, str], bare_ten: bool) -> Column:
    """Positional writing: a run of zeros inside reads as one, those at the end not at all.

    ``bare_ten``: a number that would begin with "one ten" begins with "ten".
    """
    digits, zero, (ten, hundred, thousand), myriad = script

    def full(four: Column) -> Column:
        """Every place of four digits, zeros without their units."""
        places = ((1000, thousand), (100, hundred), (10, ten), (1, ""))
        return F.concat(*(_pick([zero, *(d + unit for d in digits[1:])], _digit(four, place)) for place, unit in places))

    def tidy(text: Column) -> Column:
        out = F.btrim(F.regexp_replace(text, f"{zero}+", zero), F.lit(zero))
        return let(out, lambda t: F.when(t.startswith(digits[1] + ten), F.substring(t, 2, 1000)).otherwise(t)) if bare_ten else out

    above = lambda k, text, low: F.when(k > 0, F.concat(text, F.lit(myriad), low)).otherwise(low)
    top, middle = F.floor(n / 100_000_000), F.floor(n / 10_000) % 10_000
    high = tidy(above(top, tidy(full(top)), full(middle)))
    return F.when(n == 0, digits[0]).otherwise(tidy(above(F.floor(n / 10_000), high, full(n % 10_000))))


def _enclosed(n: Column, runs: list[tuple[int, int, str]]) -> Column:
    out = F.lit(None).cast("string")
    for a, b, sign in runs:
        out = F.coalesce(out, F.when(n.between(a, b), _pick([chr(ord(sign) + k) for k in range(b - a + 1)], n - a)))
    return F.coalesce(out, n.cast("string"))


def number_text(n: Column, fmt: Column) -> Column:
    """``n`` in the format; decimal where the format does not reach, null for an unknown format."""
    plain, own = n.cast("string"), F.greatest(n, F.lit(0))
    positive = lambda text: F.when(n > 0, text).otherwise(plain)
    sign = lambda signs: F.coalesce(F.when(n > 0, _pick(signs, n - 1)), plain)
    texts = [
        (["decimal", "decimalHalfWidth"], plain),
        (["none", "bullet"], F.lit("")),
        (["decimalZero"], F.when(n.between(0, 9), F.concat(F.lit("0"), plain)).otherwise(plain)),
        (["decimalFullWidth"], F.translate(plain, "0123456789", "".join(chr(0xFF10 + d) for d in range(10)))),
        (["upperRoman"], positive(roman(n))),
        (["lowerRoman"], F.lower(positive(roman(n)))),
        (["upperLetter"], positive(letters(n))),
        (["lowerLetter"], F.lower(positive(letters(n)))),
        (["ordinal"], ordinal(own)),
        (["cardinalText"], words(own, False)),
        (["ordinalText"], words(own, True)),
        (["hex"], F.hex(own)),
        (["arabicDash"], F.concat(F.lit("- "), plain, F.lit(" -"))),
        (CIRCLED, _enclosed(n, CIRCLES)),
        (["decimalEnclosedParen"], _enclosed(n, PARENS)),
        (["decimalEnclosedFullstop"], _enclosed(n, STOPS)),
        (COUNTED, chinese(own, COUNTING, True)),
        (["chineseLegalSimplified"], chinese(own, LEGAL_SIMPLIFIED, False)),
        (["ideographLegalTraditional"], chinese(own, LEGAL_TRADITIONAL, False)),
        (["ideographTraditional"], sign(STEMS)),
        (["ideographZodiac"], sign(BRANCHES)),
    ]
    out = F.lit(None).cast("string")
    for names, text in texts:
        out = F.when(fmt.isin(*names), text) if names[0] == "decimal" else out.when(fmt.isin(*names), text)
    return out


def number_texts(fmt: Column, n: Column) -> Column:
    """Texts of arrays of numbers in arrays of formats, null for unknown formats and null numbers."""
    return F.transform(n, lambda k, i: F.when(k.isNotNull(), number_text(k.cast("int"), F.get(fmt, i))))
