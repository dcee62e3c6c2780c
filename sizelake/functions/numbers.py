"""Numbers as Columns: reading under two conventions, shape tests, percentages, formats. No Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what a number in a text looks like, what a cell of numbers looks like
NUMBER = r"[-+]?\d[\d.,\s]*\d|\d"
NUMBER_CELL = r"^[\s\d.,]{1,12}[%A-Za-zÀ-ỹ/()\s]{0,10}$"
RANGE = r"^\s*\d+\s*[-–—]\s*\d+\s*$"


def _double(c: Column) -> Column:
    return c.try_cast("double")


# fixed values: full-width digits and marks, and blanks of other widths
_WIDE = "".join(chr(0xFF10 + k) for k in range(10)) + "．，－＋％／（）" + "\u00a0\u2002\u2003\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_NARROW = "0123456789.,-+%/()" + " " * 10


def plain_digits(c: Column) -> Column:
    """Digits, marks and blanks of other widths as the plain ones."""
    return F.translate(c, _WIDE, _NARROW)


def parse_number(text: Column, style: str = "vi", group: int = 3) -> Column:
    """The first number in the text, which may be written in full width: struct(value, raw, ambiguous, alt_value), null where there is none or it can't be read.

    Both marks: the last is decimal. One mark repeated: groups, ambiguous if uneven. One mark once: decimal unless exactly
    `group` digits follow; then groups or decimal by style, ambiguous, with the other reading as alt_value; a leading zero
    leaves the decimal reading only."""
    raw = F.regexp_extract(plain_digits(text), NUMBER, 0)
    body = F.regexp_replace(F.replace(raw, F.lit(" "), F.lit("")), r"^[-+]+", "")
    sign = F.when(F.replace(raw, F.lit(" "), F.lit("")).startswith("-"), -1.0).otherwise(1.0)
    dots, commas = F.regexp_count(body, F.lit(r"\.")), F.regexp_count(body, F.lit(","))
    dot_last = F.length(body) - F.instr(F.reverse(body), ".") > F.length(body) - F.instr(F.reverse(body), ",")
    both = F.when(dot_last, F.replace(body, F.lit(","), F.lit(""))).otherwise(F.replace(F.replace(body, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    plain = F.regexp_replace(body, "[.,]", "")
    decimal = F.replace(body, F.lit(","), F.lit("."))
    even = body.rlike(rf"^\d+(?:[.,]\d{{{group}}})+$")
    tail = F.length(F.regexp_extract(body, r"[.,](\d*)$", 1))
    zero = body.rlike(r"^0")
    as_groups = (dots == 1) if style == "vi" else (commas == 1)
    one = (dots + commas) == 1
    two_ways = one & (tail == group) & ~zero
    value = (
        F.when((dots > 0) & (commas > 0), _double(both))
        .when((dots + commas) == 0, _double(body))
        .when((dots > 1) | (commas > 1), _double(plain))
        .when(two_ways & as_groups, _double(plain))
        .otherwise(_double(decimal))
    )
    alt = F.when(two_ways, F.when(as_groups, _double(decimal)).otherwise(_double(plain)))
    ambiguous = two_ways | ((dots * commas == 0) & ((dots > 1) | (commas > 1)) & ~even)
    return F.when((raw != "") & value.isNotNull(), F.struct((sign * value).alias("value"), raw.alias("raw"), ambiguous.alias("ambiguous"), (sign * alt).alias("alt_value")))


def all_numbers(text: Column, style: str = "vi") -> Column:
    return F.transform(F.regexp_extract_all(plain_digits(text), F.lit(f"({NUMBER})"), 1), lambda x: parse_number(x, style)["value"])


def parse_percent(text: Column) -> Column:
    """A ratio where a percent sign is present, else the bare number."""
    v = parse_number(text)["value"]
    return F.when(plain_digits(text).contains("%"), v / 100).otherwise(v)


def is_number_cell(c: Column) -> Column:
    s = F.trim(F.coalesce(c, F.lit("")))
    return (s != "") & s.rlike(r"\d") & s.rlike(NUMBER_CELL)


def looks_like_value(c: Column, longest: int = 30, first_digit: int = 6, ranges: bool = True) -> Column:
    """Whether the text is one value, not a sentence that holds a number. With ranges=False ranges pass, too."""
    s = F.trim(plain_digits(F.coalesce(c, F.lit(""))))
    at = F.regexp_instr(s, F.lit(r"\d"))
    ok = (s != "") & (F.length(s) <= longest) & (at >= 1) & (at <= first_digit + 1)
    return ok & ~s.rlike(RANGE) if ranges else ok


def safe_double(c: Column) -> Column:
    return F.coalesce(_double(c), F.lit(0.0))


def whole_or_two(c: Column) -> Column:
    """Whole numbers without decimals, others with two."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(F.format_string("%.2f", c))


def four_digits(c: Column) -> Column:
    """Four significant digits, thousands grouped; large and small numbers with an exponent. What lies in the
    middle between two printed values may go to either, as the digits are brought to the front by a division."""
    size = F.floor(F.log10(F.abs(c))).cast("int")
    rounded = F.bround(c / F.pow(F.lit(10.0), size), 3)
    over = F.abs(rounded) >= 10
    exp, head = F.when(over, size + 1).otherwise(size), F.when(over, rounded / 10).otherwise(rounded)
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    fixed = F.when(exp >= 3, F.format_string("%,.0f", head * F.pow(F.lit(10.0), exp)))
    for k in (2, 1, 0, -1, -2, -3, -4):
        fixed = F.when(exp == k, bare(F.format_string(f"%.{3 - k}f", head * F.pow(F.lit(10.0), exp)))).otherwise(fixed)
    power = F.concat(bare(F.format_string("%.3f", head)), F.lit("e"), F.when(exp < 0, "-").otherwise("+"), F.lpad(F.abs(exp).cast("string"), 2, "0"))
    return F.when(c == 0, F.lit("0")).when((exp < -4) | (exp >= 4), power).otherwise(fixed)


def rewrite_convention(c: Column, convention: str) -> Column:
    """us: commas group; vn: dots group, the comma is decimal."""
    return F.replace(c, F.lit(","), F.lit("")) if convention == "us" else F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))


def half_unit(printed: Column) -> Column:
    """Half a unit of the last digit that is printed."""
    return 0.5 * F.pow(F.lit(10.0), -F.length(F.regexp_extract(printed, r"\.(\d*)$", 1)))


def relative_difference(expected: Column, declared: Column) -> Column:
    """|e-d|/|e|; at e = 0 it is 0 for equal values and infinite otherwise; null where either side is."""
    return F.when(expected.isNull() | declared.isNull(), F.lit(None).cast("double")).when(expected != 0, F.try_divide(F.abs(expected - declared), F.abs(expected))).when(declared == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))


SUFFIXES = {"": 0, "K": 1, "Ki": 1, "M": 2, "Mi": 2, "G": 3, "Gi": 3, "T": 4, "Ti": 4, "P": 5, "Pi": 5}


def suffix_factor(suffix: Column, base: int = 1024) -> Column:
    out = F.lit(None).cast("double")
    for k, p in SUFFIXES.items():
        out = F.when(suffix == k, F.lit(float(base**p))).otherwise(out)
    return out
