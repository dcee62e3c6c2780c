"""Text functions as Columns: normal forms, tokens, cuts, detectors. No Python at run time."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# letters of any alphabet that are a letter and marks
_ACCENTED = [c for c in map(chr, range(0xC0, 0x2000)) if len(d := unicodedata.normalize("NFD", c)) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])]
PLAIN_FROM = "".join(_ACCENTED) + "đĐ"
PLAIN_TO = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED) + "dD"
#: Blanks of any kind, line ends included.
BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: The same blanks, as a class that Java tests in half the time.
FAST_BLANKS = r"(?U)[\s\x1c-\x1f]+"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, FAST_BLANKS, " "))


def norm(c: Column) -> Column:
    """Lower case, one blank between words, without a leading [...] of up to 80 signs."""
    return F.lower(squeeze(F.when(F.contains(c, F.lit("[")), F.regexp_replace(c, r"^\s*\[[^\]]{0,80}\]\s*", "")).otherwise(c)))


def run_hashes(words: str, n: Column) -> Column:
    """A hash of each run of n neighbouring words of an array column, in order; none where there are fewer words."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(words, i, n)))


def fold_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def strip_accents(c: Column) -> Column:
    """Letters without their marks, whether composed or not, and đ as d."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), PLAIN_FROM, PLAIN_TO)


def tokens(c: Column, stop: tuple[str, ...] = (), longer_than: int = 1) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > longer_than) & ~w.isin(*stop) if stop else F.length(w) > longer_than))


def cut_at_word(c: Column, limit: int = 160) -> Column:
    """At most `limit` signs, cut behind a word, with an ellipsis."""
    s = squeeze(c)
    head = F.substring(s, 1, limit)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.when(head.contains(" "), F.regexp_extract(head, r"^(.*) ", 1)).otherwise(head), F.lit("…")))


def cut_hard(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def table_cell(c: Column, limit: int = 170) -> Column:
    """A cell of a Markdown table: one line, bars escaped, what is too long cut with an ellipsis; `limit` signs at most."""
    s = F.replace(squeeze(c), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…")))


def outer_json(c: Column) -> Column:
    """The outermost {...}, code fences and prose around it dropped."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


# fixed values: entities that are decoded
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&hellip;", "…"), ("&amp;", "&"))


def html_to_text(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</p>|</div>|</li>|</tr>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def html_table(c: Column) -> Column:
    """The first table of a text as an array of rows: the cells of its head's first row, if it has a head, then those of the
    rows of its body; rows without cells are left out."""
    cells = lambda row, tag: F.transform(F.regexp_extract_all(row, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1), html_to_text)
    head = F.regexp_extract(c, r"(?is)<thead(?:\s[^>]*)?>.*?<tr(?:\s[^>]*)?>(.*?)</tr>.*?</thead>", 1)
    body = F.regexp_extract(c, r"(?is)<tbody(?:\s[^>]*)?>(.*?)</tbody>", 1)
    rows = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>"), 1), lambda r: cells(r, "td"))
    return F.filter(F.concat(F.array(cells(head, "th")), rows), lambda r: F.size(r) > 0)


def section_root(c: Column) -> Column:
    return F.upper(F.trim(F.substring_index(F.coalesce(c, F.lit("")), ".", 1)))


def group_code(c: Column) -> Column:
    return F.substring_index(c, "-", 1)


def instance_key(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9_-]", "_")


CAPTION = r"(?iu)^\s*(hình|biểu đồ|sơ đồ|ảnh|bảng|figure|table)\s*[\d.]*\s*[:.\-]?\s*\S+"


def is_caption(c: Column) -> Column:
    s = F.trim(F.coalesce(c, F.lit("")))
    return (F.length(s) <= 200) & s.rlike(CAPTION)


def heading_number(c: Column) -> Column:
    """struct(number, level): Roman numeral or dotted Arabic number before a heading."""
    n = F.regexp_extract(c, r"^\s*([IVXLC]+(?:\.\d+)*|\d+(?:\.\d+)*)[.)]?\s+\S", 1)
    return F.when(n != "", F.struct(n.alias("number"), F.size(F.split(n, r"\.")).alias("level")))


def sentences(c: Column, longer_than: int = 25) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?;])\s+|\n+"), lambda s: F.trim(s)), lambda s: F.length(s) > longer_than)


def cited_numbers(c: Column, word: str) -> Column:
    """Sorted distinct numbers that follow a word, such as pages or sections."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit(rf"{word}\s*(\d+)"), 1), lambda x: x.cast("int"))))


def file_family(c: Column) -> Column:
    """A file's name without extension, leading date or copy mark, and version endings (taken off three times)."""
    c = F.regexp_replace(F.lower(c), r"\.[a-z0-9]{2,5}$", "")
    c = F.regexp_replace(c, r"^(?:\d{6,8}[ _-]+|copy of |bản sao của )", "")
    for _ in range(3):
        c = F.regexp_replace(c, r"[ _-]*(?:v\d+(?:\.\d+)*|\(\d+\)|final|ok|new|\d{4,8}|_\d+)$", "")
    return F.trim(F.regexp_replace(c, r"[ _-]+", " "))


def bijective_letters(n: Column) -> Column:
    """1 → a, 26 → z, 27 → aa: up to three letters."""
    one = lambda k: F.chr(F.lit(97).cast("bigint") + k.cast("bigint"))
    n0 = n - 1
    two = F.floor(n0 / 26) - 1
    three = F.floor(two / 26) - 1
    return F.concat(F.when(three >= 0, one(F.pmod(three, F.lit(26)))).otherwise(""), F.when(two >= 0, one(F.pmod(two, F.lit(26)))).otherwise(""), one(F.pmod(n0, F.lit(26))))


def roman(n: Column) -> Column:
    out = F.lit("")
    for v, s in ((100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        k = F.floor(n / v)
        out = F.concat(out, F.repeat(F.lit(s), k.cast("int")))
        n = n - k * v
    return out


def token_f1(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def is_email(c: Column) -> Column:
    return c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")
