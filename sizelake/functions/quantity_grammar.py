"""A grammar for amounts as authors write them.

amount  := approx? part (blank part)*         part   := number scale-word* unit?
number  := digits and marks (('e' | '× 10^') exponent)?
unit    := factor (times factor | per factor)*  factor := atom power?
atom    := alias | time | transaction | prefix atom | unknown word

A unit is a factor, an offset and a vector of exponents over base dimensions, so that 'MB/giây' is byte^1 time^-1. Amounts
can be compared where the vectors are equal. Units that the table lists without a factor, and units nobody knows, are
dimensions of their own: only equal ones compare.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from sizelake.functions.unicode_forms import as_latin, base_form, fold

# fixed values: number words
SCALES = {
    "tram": 1e2, "nghin": 1e3, "ngan": 1e3, "k": 1e3, "van": 1e4, "trieu": 1e6, "tr": 1e6, "ty": 1e9, "ti": 1e9,
    "thousand": 1e3, "million": 1e6, "billion": 1e9, "hundred": 1e2,
}
# fixed values: words for time, in seconds
TIMES = {
    "s": 1.0, "sec": 1.0, "secs": 1.0, "second": 1.0, "seconds": 1.0, "giay": 1.0,
    "min": 60.0, "mins": 60.0, "minute": 60.0, "minutes": 60.0, "phut": 60.0, "ph": 60.0,
    "h": 3600.0, "hr": 3600.0, "hrs": 3600.0, "hour": 3600.0, "hours": 3600.0, "gio": 3600.0,
    "d": 86400.0, "day": 86400.0, "days": 86400.0, "ngay": 86400.0, "week": 604800.0, "weeks": 604800.0, "tuan": 604800.0,
    "month": 2592000.0, "months": 2592000.0, "thang": 2592000.0, "year": 31536000.0, "years": 31536000.0, "nam": 31536000.0,
}
# fixed values: prefixes, as powers of 1024 for stored bytes and of 1000 for rates
PREFIXES = {"": 0, "k": 1, "m": 2, "g": 3, "t": 4, "p": 5}
# fixed values: words for one transaction
TRANSACTIONS = {"giao dich", "gd", "req", "reqs", "request", "requests", "transaction", "transactions", "tx", "yeu cau"}
# fixed values: words before an amount that leave it a single value
APPROX = r"(?:~|≈|±|khoang|xap xi|tam|chung|uoc|approx\.?|about|ca\.)"
# fixed values: temperature, the one family with an offset: kelvin = factor * (x + offset)
TEMPERATURES = {"k": (1.0, 0.0), "°k": (1.0, 0.0), "°c": (1.0, 273.15), "do c": (1.0, 273.15), "°f": (5 / 9, 459.67)}

# fixed values: decimal prefixes of units that are neither bytes nor bits
DECIMAL = {"k": 1e3, "K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15, "m": 1e-3, "µ": 1e-6, "μ": 1e-6, "n": 1e-9}
_SUPERSCRIPT = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")
_PER = re.compile(r"\s*(?:/|(?<=\s)(?:tren|moi|per)(?=\s))\s*", re.I)
_TIMES = re.compile(r"\s*[·*×⋅]\s*|(?<=[^\W\d_])\.(?=[^\W\d_])")
_POWER = re.compile(r"(.*?[^\W\d_])\s*(?:\^\s*\(?(-?\d)\)?|([⁻]?[¹²³⁴-⁹])|([2-9]))")

_NUMBER = r"\d+(?:[ ]\d{3}(?!\d))+(?:[.,]\d+)?|\d+(?:[.,]\d+)*"
_EXPONENT = r"(?:[eE](?P<e>[-+]?\d{1,2})(?![\w.,])|\s*[x×*]\s*10(?:\s*\^\s*(?P<p>[-+]?\d{1,2})|(?P<s>[⁻]?[⁰¹²³⁴-⁹]+))(?![\w]))?"
_TOKEN = re.compile(rf"\s*(?P<sign>[-−+]?)(?P<num>{_NUMBER}){_EXPONENT}")
# fixed values: signs and words of a bound, which leaves one side open
_BOUND = re.compile(r"[<>≤≥]|(?<!\w)(?:toi da|toi thieu|tro len|tro xuong|or more|or less|up to|at least|at most)(?!\w)")
_RANGE = re.compile(r"\d\s*(?:-|–|—|÷|\.\.+|…|~|den|to)\s*\d")


@dataclass(frozen=True)
class Unit:
    """dims: sorted (dimension, exponent) pairs; base amount = factor * (amount + offset)."""

    dims: tuple
    factor: float = 1.0
    offset: float = 0.0
    base: str = ""
    group: str = ""


@dataclass
class UnitTable:
    """Aliases from rows (unit_group, unit, alias, case_sensitive, factor, base_unit), completed by the grammar.

    rows may hold nulls and repeats: rows without an alias or unit are passed over, the first of equal aliases counts."""

    rows: list
    exact: dict = field(default_factory=dict)
    folded: dict = field(default_factory=dict)
    memo: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for group, unit, alias, sensitive, factor, base in self.rows:
            if not alias or not unit:
                continue
            u = self._of(group, unit, factor, base)
            if sensitive:
                self.exact.setdefault(_squeeze(alias), u)
            else:
                self.folded.setdefault(_squeeze(alias).lower(), u)
                self.folded.setdefault(fold(_squeeze(alias)), u)

    @staticmethod
    def _of(group, unit, factor, base) -> Unit:
        if factor is None:
            return Unit(((f"unit:{unit}", 1),), 1.0, 0.0, unit, group or "")
        dims = {"dung_luong": (("byte", 1),), "bang_thong": (("bit", 1), ("time", -1)), "thoi_gian": (("time", 1),), "giao_dich": (("time", -1), ("txn", 1))}
        return Unit(dims.get(group, ((f"group:{group}", 1),)), float(factor), 0.0, base or unit, group or "")

    def resolve(self, text: str | None) -> Unit | None:
        """The unit that the whole text names; None if it names none."""
        if text is None:
            return None
        if text not in self.memo:
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[text] = self._resolve(text)
        return self.memo[text]

    def _resolve(self, text: str) -> Unit | None:
        t = _squeeze(as_latin(base_form(text)))
        t = re.sub(r"^[\s.,;:*'\"()\[\]]+|[\s.,;:*'\"()\[\]]+$", "", t)
        if not t:
            return None
        if t in self.exact:
            return self.exact[t]
        if t.lower() in self.folded:
            return self.folded[t.lower()]
        return self._grammar(t) or self.folded.get(fold(t))

    def _grammar(self, t: str) -> Unit | None:
        low = fold(t)
        if low in TEMPERATURES and low != "k":
            f, o = TEMPERATURES[low]
            return Unit((("kelvin", 1),), f, o, "K", "nhiet_do")
        if m := re.fullmatch(r"([kKmMgGtTpP]?)(i?)([bB]yte|[bB]|[bB]yt)s?", t) or re.fullmatch(r"(?i)(kilo|mega|giga|tera|peta)?()bytes?", t):
            return Unit((("byte", 1),), 1024.0 ** PREFIXES[(m[1] or "")[:1].lower()], 0.0, "byte", "dung_luong")
        if m := re.fullmatch(r"([kKmMgGtTpP]?)(i?)(b|B|[bB]yte|[bB]it|BYTE|BIT)s?\s*(?:/\s*(\S+)|(ps))", t):
            per = 1.0 if m[5] else TIMES.get(fold(m[4]))
            if per is None:
                return None
            bits = 8.0 if m[3] == "B" or m[3].lower() == "byte" else 1.0
            return Unit((("bit", 1), ("time", -1)), bits * (1024.0 if m[2] else 1000.0) ** PREFIXES[m[1].lower()] / per, 0.0, "bps", "bang_thong")
        if low in TIMES:
            return Unit((("time", 1),), TIMES[low], 0.0, "giay", "thoi_gian")
        return self.compound(t)

    def _atom(self, t: str, unknown: bool) -> Unit | None:
        low = fold(t)
        if t in self.exact:
            return self.exact[t]
        if (u := self.folded.get(t.lower()) or self.folded.get(low)) is not None:
            return u
        if low in TEMPERATURES and low != "k":
            return Unit((("kelvin", 1),), TEMPERATURES[low][0], 0.0, "K", "nhiet_do")  # a difference, within a compound
        if m := re.fullmatch(r"([kKmMgGtTpP]?)i?([bB]yte|B|[bB]yt)s?", t):
            return Unit((("byte", 1),), 1024.0 ** PREFIXES[m[1].lower()], 0.0, "byte", "dung_luong")
        if m := re.fullmatch(r"([kKmMgGtTpP]?)(i?)(?:b|[bB]it)s?", t):
            return Unit((("bit", 1),), (1024.0 if m[2] else 1000.0) ** PREFIXES[m[1].lower()], 0.0, "bit", "bang_thong")
        if low in TIMES:
            return Unit((("time", 1),), TIMES[low], 0.0, "giay", "thoi_gian")
        if low in TRANSACTIONS:
            return Unit((("txn", 1),), 1.0, 0.0, "giao dich", "giao_dich")
        if t[:1] in DECIMAL and len(t) > 1 and (len(t) > 2 or t[1].isupper() or (t[0] in "mµμn" and t[1] == "s")):
            rest = self.exact.get(t[1:]) or self.folded.get(t[1:].lower()) or (Unit((("time", 1),), 1.0, 0.0, "giay", "thoi_gian") if t[1:] == "s" else None)
            if rest is not None and not rest.offset and ("byte", 1) not in rest.dims and not any(k == "bit" for k, _ in rest.dims):
                return Unit(rest.dims, rest.factor * DECIMAL[t[0]], 0.0, rest.base, rest.group)
        return Unit(((f"word:{low}", 1),), 1.0, 0.0, low, "") if unknown and re.fullmatch(r"[^\W\d_%°]+(?: [^\W\d_]+)*|[%°]", t) else None

    def compound(self, t: str, unknown: bool = False) -> Unit | None:
        """A product and quotient of powers of atoms: exponents add up, factors multiply. With unknown, words that nobody
        knows are dimensions of their own. Any slash divides by what stands right behind it."""
        parts = _PER.split(fold_marks(t))
        dims: dict[str, int] = {}
        factor, bases, group = 1.0, [], None
        pieces = [(x, 1 if k == 0 else -1) for k, part in enumerate(parts) for x in ([part] if self._known(part) else _TIMES.split(part))]
        if len(parts) > 2 and (head := self._resolve(f"{parts[0]}/{parts[1]}")) is not None:  # a rate, which has rules of its own, per something
            dims, factor, bases, group = dict(head.dims), head.factor, [(head.base, 1)], head.group
            pieces = [(x, -1) for part in parts[2:] for x in ([part] if self._known(part) else _TIMES.split(part))]
        for text, sign in pieces:
            text, power = text.strip(), 1
            u = self._atom(text, False)
            if u is None and (m := _POWER.fullmatch(text)):
                text, power = m[1].strip(), int(m[2] or (m[3] or "").translate(_SUPERSCRIPT) or m[4])
                u = self._atom(text, unknown)
            elif u is None:
                u = self._atom(text, unknown)
            if u is None or not text:
                return None
            n = sign * power
            for k, v in u.dims:
                dims[k] = dims.get(k, 0) + n * v
            factor *= u.factor**n
            bases.append((u.base, n))
            group = u.group if group is None else group
        made = tuple(sorted((k, v) for k, v in dims.items() if v))
        if made == (("time", -1), ("txn", 1)):
            return Unit(made, factor, 0.0, "tps", "giao_dich")
        up = "·".join(b + (f"^{n}" if n > 1 else "") for b, n in bases if n > 0) or "1"
        down = "".join("/" + b + (f"^{-n}" if n < -1 else "") for b, n in bases if n < 0)
        return Unit(made, factor, 0.0, up + down, group or "")

    def _known(self, t: str) -> bool:
        return t.strip() in self.exact or t.strip().lower() in self.folded

    def at_start(self, text: str) -> Unit | None:
        """The longest unit that the text begins with, of up to four words; it must end at a boundary."""
        t = _squeeze(as_latin(base_form(text)))
        ends = [m.end() for m in re.finditer(r"[^\s]+", t)][:4]
        for end in reversed(ends):
            cut = t[:end]
            for piece in (cut, re.sub(r"[.,;:)\]]+$", "", cut)):
                if piece and (u := self.resolve(piece)) is not None:
                    return u
        return None


def fold_marks(t: str) -> str:
    """Words for «per» without accents, so that they can be told; all else stays."""
    return re.sub(r"(?<=\s)(?:trên|mỗi)(?=\s)", "per", t)


def _squeeze(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def read_number(s: str) -> float | None:
    """A number in the Vietnamese way; see TESTDATA: the last of two marks is decimal, repeated marks group thousands, a
    single dot before exactly three digits groups unless 0 stands before it, any other single mark is decimal."""
    s = s.replace(" ", "")
    dots, commas = s.count("."), s.count(",")
    if dots and commas:
        last = max(s.rfind("."), s.rfind(","))
        mark = s[last]
        other = "," if mark == "." else "."
        if s.count(mark) > 1:  # both repeated or the last repeated: no reading has one decimal mark
            s = s.replace(".", "").replace(",", "")
        else:
            s = s.replace(other, "").replace(mark, ".")
    elif dots > 1 or commas > 1:
        s = s.replace(".", "").replace(",", "")
    elif dots == 1:
        whole, frac = s.split(".")
        if len(frac) == 3 and whole.strip("0") != "":
            s = whole + frac
    elif commas == 1:
        s = s.replace(",", ".")
    try:
        return float(s)
    except ValueError:
        return None


def _clean(raw: str) -> str:
    return _squeeze(base_form(raw))


def parse_amount(raw: str | None, units: UnitTable) -> tuple[list[tuple[float, Unit | None]], str] | None:
    """The parts (number, unit or None) of the amount and the text of its first number; None if raw is no single value."""
    if raw is None:
        return None
    s = _clean(raw)
    low = fold(s)
    if not s or len(low) != len(s) or not any(c.isdigit() for c in s):
        if len(low) != len(s):
            s = low
        if not any(c.isdigit() for c in s):
            return None
    low = low.strip()
    if m := re.match(rf"^(?:{APPROX}\s*)+", low):
        s, low = s[m.end() :], low[m.end() :]
    if _RANGE.search(low) or _BOUND.search(low):
        return None
    parts, pos, first = [], 0, ""
    while pos < len(s):
        m = _TOKEN.match(s, pos)
        if not m:
            return None
        x = read_number(m["num"])
        if x is None:
            return None
        x *= 10.0 ** int(m["e"] or m["p"] or (m["s"] or "0").translate(_SUPERSCRIPT))
        first = first or m["num"]
        if m["sign"] in "-−" and m["sign"]:
            if parts:
                return None
            x = -x
        pos = m.end()
        nxt = re.search(r"(?<![A-Za-z0-9^])\d|(?<=\s)\d|$", s[pos:])
        tail = s[pos : pos + nxt.start()] if nxt else s[pos:]
        # a digit glued to letters (CINT2017) belongs to the unit
        pos += len(tail)
        words = tail.split()
        while words and fold(words[0]) in SCALES and not (fold(words[0]) == "k" and len(words) > 1 and units.resolve(" ".join(words[1:])) is None):
            x *= SCALES[fold(words[0])]
            words.pop(0)
        unit_text = " ".join(words).strip(" .,;")
        if unit_text in ("va", "và", "and", "+"):
            unit_text = ""
        unit_text = re.sub(r"\s+(?:và|va|and|\+)$", "", unit_text)
        unit = None
        if unit_text:
            unit = units.resolve(unit_text)
            if unit is None and len(unit_text) <= 30:
                unit = units.compound(unit_text, unknown=True)
            if unit is None:
                letters = fold(unit_text)
                if not re.fullmatch(r"[a-z%°/ .]{1,30}", letters):
                    return None
                unit = Unit(((f"word:{letters}", 1),), 1.0, 0.0, letters, "")
        parts.append((x, unit))
    return (parts, first) if parts and len(parts) <= 3 else None


def unit_behind(number: str, raw: str, quote: str | None, units: UnitTable) -> Unit | None:
    """The unit right behind the amount's number in the quoted sentence. Where the number itself isn't in the quote (it was
    altered there), the first standing number with a unit right behind it counts."""
    if not quote:
        return None
    q = as_latin(base_form(quote))
    q = re.sub(r"\s+", " ", q)
    standing = [m for m in re.finditer(rf"(?<![\w.,–-])(?:{_NUMBER})", q)]
    for m in [x for x in standing if x.group() == number] or standing:
        rest = q[m.end() :].lstrip()
        while (w := re.match(r"(\S+)\s*", rest)) and fold(w[1]) in SCALES and fold(w[1]) != "k":
            rest = rest[w.end() :]
        if rest and (u := units.at_start(rest)) is not None:
            return u
    return None


def bracket(header: str | None) -> str | None:
    """The text in the last brackets of a column header."""
    if not header:
        return None
    m = re.findall(r"[(\[]([^()\[\]]*)[)\]]", base_form(header))
    return m[-1] if m else None


def to_base(raw: str | None, beside: str | None, quote: str | None, by_name: str | None, units: UnitTable):
    """(amount in base units, vector as text, base unit, group, where the unit came from); None if raw is no single value or
    no source names a unit. beside: don_vi or the brackets of the header."""
    got = parse_amount(raw, units)
    if got is None:
        return None
    parts, number = got
    source = "own"
    if parts[-1][1] is None:
        u = None
        for source, find in (("beside", lambda: units.resolve(beside)), ("quote", lambda: unit_behind(number, raw, quote, units)), ("rule", lambda: units.resolve(by_name))):
            u = find()
            if u is not None:
                break
        if u is None:
            u, source = Unit((("none", 1),)), "none"
        parts[-1] = (parts[-1][0], u)
    total, dims, last = 0.0, parts[-1][1].dims, parts[-1][1]
    for x, u in parts:
        u = u or last
        if u.dims != dims:
            return None
        total += u.factor * (x + u.offset)
    return total, ";".join(f"{d}^{e}" for d, e in dims), last.base, last.group, source
