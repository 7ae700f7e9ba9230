"""Text and number expressions that the operators share. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first and the last year that is plausible.
YEARS = (1850, 2029)
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def norm(c: Column) -> Column:
    """Lower case, only letters a-z and digits: the key of comparisons that ignore case, blanks and punctuation."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def norm_value(text: str) -> str:
    return "".join(ch for ch in text.lower() if ch in _LOWER or ch in "0123456789")


def norm_contains(c: Column, value: str) -> Column:
    """Contains, by ``norm`` on both sides. A value of punctuation alone matches every row that is not null."""
    return norm(c).contains(norm_value(value))


def all_words(c: Column, value: str) -> Column:
    """Every word of ``value`` occurs, in any order and case; ``%`` and ``_`` inside words are wildcards."""
    out = c.isNotNull()
    for word in value.split():
        out = out & c.ilike(f"%{word}%")
    return out


def words(c: Column) -> Column:
    """Blank-separated words."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Runs of letters or of digits, in lower case: 'CB1000R' gives cb, 1000, r."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z]+|[0-9]+"), F.lit(0))


def number_with_unit(c: Column, unit: str) -> Column:
    """The first number before ``unit``; null without one or where it is no number."""
    return F.nullif(F.regexp_extract(c, rf"(?i)([0-9.]+)\s*(?:{unit})", 1), F.lit("")).try_cast("double")


def digits(c: Column) -> Column:
    """All digits of a text as one number, or null."""
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")).try_cast("long")


def date_or_null(c: Column) -> Column:
    """``YYYYMMDD`` as a date; anything else is null."""
    return F.when(c.rlike("^[0-9]{8}$"), F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date"))


def rot13(c: Column) -> Column:
    turned = _LOWER[13:] + _LOWER[:13]
    return F.translate(c, _LOWER + _UPPER, turned + turned.upper())


def half_up(c: Column) -> Column:
    """To the nearest whole number, halves upwards."""
    return F.floor(c + 0.5)


def round_exact(c: Column, digits: int) -> Column:
    """To ``digits`` decimals (9 at most) by the exact binary value, ties to the even digit, as Python's ``round``; of values under 8, others are null.

    The value is taken apart into whole 2**-60ths, whole 2**-113ths of the rest, and whether anything is left; these are compared with the tie
    as whole numbers.
    """
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  a value that is used again is made once
    whole_number = lambda x, size: x.cast(f"decimal({size},0)")
    unit, part, scale = whole_number(F.lit(1 << 60), 19), whole_number(F.lit(1 << 53), 16), whole_number(F.lit(10**digits), 10)
    digit = whole_number(unit * part, 36)

    def apart(x: Column) -> Column:
        high = F.abs(x) * float(1 << 60)
        return F.struct(x.alias("x"), whole_number(whole_number(F.floor(high), 19) * scale, 30).alias("times"), ((high - F.floor(high).cast("double")) * float(1 << 53)).alias("low"))

    def near(v: Column) -> Column:
        return F.struct(v["x"].alias("x"), v["times"].alias("times"), v["low"].alias("low"), whole_number(F.floor(v["times"] / unit), 20).alias("below"))

    def fit(v: Column) -> Column:  # a quotient has few decimals
        right = F.when(whole_number(v["below"] * unit, 38) > v["times"], -1).when(whole_number((v["below"] + 1) * unit, 38) <= v["times"], 1).otherwise(0)
        return F.struct(v["x"].alias("x"), v["times"].alias("times"), v["low"].alias("low"), whole_number(v["below"] + right, 20).alias("below"))

    def left(v: Column) -> Column:  # of a digit, in 2**-113ths
        rest = whole_number(whole_number(v["times"] - whole_number(v["below"], 12) * unit, 19) * part, 36) + whole_number(F.floor(v["low"]), 16) * scale
        return F.struct(v["x"].alias("x"), v["below"].alias("below"), whole_number(rest, 38).alias("rest"), (v["low"] > F.floor(v["low"]).cast("double")).alias("more"))

    def carried(v: Column) -> Column:
        over = v["rest"] >= digit
        return F.struct(v["x"].alias("x"), whole_number(v["below"] + F.when(over, 1).otherwise(0), 20).alias("below"), whole_number(v["rest"] - F.when(over, digit).otherwise(0), 38).alias("rest"), v["more"].alias("more"))

    def told(v: Column) -> Column:
        up = (v["rest"] * 2 > digit) | (v["rest"] * 2 == digit) & (v["more"] | (v["below"] % 2 == 1))
        return F.when(F.abs(v["x"]) < 8, F.signum(v["x"]) * (v["below"] + F.when(up, 1).otherwise(0)).cast("double") / float(10**digits))

    out = let(c, apart)
    for step in (near, fit, left, carried, told):
        out = let(out, step)
    return out


def split_first(c: Column) -> tuple[Column, Column]:
    """Before and after the first blank."""
    return F.substring_index(c, " ", 1), F.when(F.instr(c, " ") > 0, F.substr(c, F.instr(c, " ") + 1)).otherwise(F.lit(""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def straight_quotes(c: Column) -> Column:
    """Acute accents that stand for apostrophes become apostrophes."""
    return F.replace(c, F.lit("\u00b4"), F.lit("'"))


def without_suffix(c: Column, suffix: Column) -> Column:
    return F.when(c.endswith(suffix), F.substring(c, F.lit(1), F.length(c) - F.length(suffix))).otherwise(c)


def starts_with_any(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def plain_words(c: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.split(c, r"[^\p{L}\p{N}_]+")


def is_year(word: Column) -> Column:
    """Whether a word is a plausible year: four digits, compared as a number."""
    return F.coalesce((F.length(word) == 4) & F.translate(word, "0123456789", "").eqNullSafe("") & word.try_cast("int").between(*YEARS), F.lit(False))


def year_in(c: Column) -> Column:
    """The first plausible year that stands as a word of its own, or null."""
    return F.get(F.filter(plain_words(c), is_year), F.lit(0)).try_cast("int")


def newest_first(low: Column, high: Column) -> Column:
    """All years from ``high`` down to ``low``; none if they cross."""
    return F.when(high >= low, F.sequence(high, low, F.lit(-1))).otherwise(F.array().cast("array<int>"))
