"""Number texts written digit by digit: what the column expressions are held against."""

from __future__ import annotations

import re

from foliant.functions.numbers import BRANCHES, CIRCLED, CIRCLES, COUNTED, COUNTING, LEGAL_SIMPLIFIED, LEGAL_TRADITIONAL, ONES, ONES_ORDINAL, PARENS, STEMS, STOPS, TENS, TENS_ORDINAL

SCALES = [(10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")]
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def roman(n: int) -> str:
    out = ""
    for value, sign in ROMAN:
        out += sign * (n // value)
        n %= value
    return out


def letters(n: int) -> str:
    """A to Z, then AA, BB and so on."""
    return chr(65 + (n - 1) % 26) * ((n - 1) // 26 + 1)


def ordinal(n: int) -> str:
    ending = "th" if 10 <= n % 100 <= 20 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
    return f"{n}{ending}"


def words(n: int, last: bool = False) -> str:
    """A number in words; with ``last`` its last word is an ordinal."""
    if n < 20:
        return (ONES_ORDINAL if last else ONES)[n]
    for scale, name in SCALES:
        if n >= scale:
            count, rest = divmod(n, scale)
            return f"{words(count)} {name}" + (f" {words(rest, last)}" if rest else "th" if last else "")
    tens, one = divmod(n, 10)
    return f"{TENS[tens]}-{words(one, last)}" if one else (TENS_ORDINAL if last else TENS)[tens]


def chinese(n: int, script: tuple[str, str, str, str], bare_ten: bool) -> str:
    """Positional writing: a run of zeros inside reads as one, those at the end not at all.

    ``bare_ten``: a number that would begin with "one ten" begins with "ten".
    """
    digits, zero, (ten, hundred, thousand), myriad = script
    if n == 0:
        return digits[0]

    def full(four: int) -> str:
        """Every place of four digits, zeros without their units."""
        return "".join(digits[int(d)] + unit if d != "0" else zero for d, unit in zip(f"{four:04d}", (thousand, hundred, ten, "")))

    high, low = divmod(n, 10_000)
    text = full(low)
    if high:
        text = chinese(high, script, bare_ten) + myriad + text
    text = re.sub(f"{zero}+", zero, text).strip(zero)
    return text[1:] if bare_ten and text.startswith(digits[1] + ten) else text


def _enclosed(n: int, runs: list[tuple[int, int, str]]) -> str:
    return next((chr(ord(sign) + n - a) for a, b, sign in runs if a <= n <= b), str(n))


def number_text(n: int, fmt: str) -> str | None:
    """``n`` in the format; decimal where the format does not reach, None for an unknown format."""
    if fmt in ("decimal", "decimalHalfWidth"):
        return str(n)
    if fmt in ("none", "bullet"):
        return ""
    if fmt == "decimalZero":
        return f"{n:02d}" if n >= 0 else str(n)
    if fmt == "decimalFullWidth":
        return str(n).translate({48 + i: 0xFF10 + i for i in range(10)})
    if fmt in ("upperRoman", "lowerRoman"):
        text = roman(n) if n > 0 else str(n)
        return text.lower() if fmt == "lowerRoman" else text
    if fmt in ("upperLetter", "lowerLetter"):
        text = letters(n) if n > 0 else str(n)
        return text.lower() if fmt == "lowerLetter" else text
    own = max(n, 0)
    if fmt == "ordinal":
        return ordinal(own)
    if fmt in ("cardinalText", "ordinalText"):
        return words(own, fmt == "ordinalText").capitalize()
    if fmt == "hex":
        return f"{own:X}"
    if fmt == "arabicDash":
        return f"- {n} -"
    if fmt in CIRCLED:
        return _enclosed(n, CIRCLES)
    if fmt == "decimalEnclosedParen":
        return _enclosed(n, PARENS)
    if fmt == "decimalEnclosedFullstop":
        return _enclosed(n, STOPS)
    if fmt in COUNTED:
        return chinese(own, COUNTING, True)
    if fmt == "chineseLegalSimplified":
        return chinese(own, LEGAL_SIMPLIFIED, False)
    if fmt == "ideographLegalTraditional":
        return chinese(own, LEGAL_TRADITIONAL, False)
    if fmt == "ideographTraditional":
        return STEMS[n - 1] if 1 <= n <= len(STEMS) else str(n)
    if fmt == "ideographZodiac":
        return BRANCHES[n - 1] if 1 <= n <= len(BRANCHES) else str(n)
    return None
