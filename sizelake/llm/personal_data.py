"""Problem 8: personal information inside free text.

Offset-preserving deobfuscation: transducers normalise character forms and look-alikes, at/dot disguises and spelled digits
while keeping, for each normalised sign, the span it came from; identifiers are detected in the normalised text and their
spans are mapped back to the source, which is replaced by typed placeholders and otherwise left as it was.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sizelake.functions import unicode_forms as U

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

_DIRTY = re.compile(U.DIRTY)
_LATIN = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.normalize("NFD", chr(c))[0].isascii() or chr(c) in "đĐ"]
UP = "A-Z" + "".join(c for c in _LATIN if c.isupper())
LOW = "a-z" + "".join(c for c in _LATIN if c.islower())
_CHARS = {c: None for c in U.INVISIBLE} | {c: " " for c in U.SPACES} | U.FULLWIDTH | U.LATIN_TWINS | U.STYLED


class Traced:
    """A normalised text; start[i], end[i] is the source span of its sign i."""

    __slots__ = ("text", "start", "end")

    def __init__(self, text: str, start, end):
        self.text, self.start, self.end = text, start, end

    def rewritten(self, pattern: re.Pattern, make) -> Traced:
        """Each match replaced by make(match) (None leaves it); all signs of a replacement have the span of the match."""
        out, start, end, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = make(m)
            if new is None or m.end() == m.start():
                continue
            a, b = m.span()
            out += [self.text[last:a], new]
            start += list(self.start[last:a]) + [self.start[a]] * len(new)
            end += list(self.end[last:a]) + [self.end[b - 1]] * len(new)
            last = b
        if not last:
            return self
        return Traced("".join(out) + self.text[last:], start + list(self.start[last:]), end + list(self.end[last:]))


# what the first transducer may change: a sign with marks or invisible signs behind it, or a sign that has another form
_CLUSTER = re.compile(rf"(?s).[\u0300-\u036f{U.INVISIBLE}]+|{U.DIRTY}")


def characters(source: str) -> Traced:
    """First transducer: character forms. A base letter and its marks become one composed sign where one exists. Only the
    clusters that may change are looked at; what lies between is copied."""
    if not _DIRTY.search(source):
        return Traced(source, range(len(source)), range(1, len(source) + 1))
    out, start, end, last = [], [], [], 0
    for m in _CLUSTER.finditer(source):
        i, n = m.span()
        if i > last:
            out.append(source[last:i])
            start.extend(range(last, i))
            end.extend(range(last + 1, i + 1))
        last = n
        while i < n:
            c = _CHARS.get(source[i], source[i])
            if c is None:
                i += 1
                continue
            cluster, j, stop = c, i + 1, i + 1
            while j < n:
                if source[j] not in U.INVISIBLE:
                    cluster += source[j]
                    stop = j + 1
                j += 1
            made = U.as_latin(cluster)
            out.append(made)
            start += [i] * len(made)
            end += [stop] * len(made)
            i = j
    out.append(source[last:])
    start.extend(range(last, len(source)))
    end.extend(range(last + 1, len(source) + 1))
    return Traced("".join(out), start, end)


_OPEN, _CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
_AT_WORD, _DOT_WORD = r"(?:at|a c[òo]ng|@)", r"(?:dot|ch[ấa]m|\.)"
_AT = re.compile(rf"(?<=\w)\s*{_OPEN}{_AT_WORD}{_CLOSE}\s*(?=\w)|(?<=\w)\s+@\s+(?=\w)|(?<=\w)\s@(?=\w+\.\w)|(?<=\w)@\s(?=\w+\.\w)", re.I)
_DOT = re.compile(rf"(?<=\w)\s*{_OPEN}{_DOT_WORD}{_CLOSE}\s*(?=\w)|(?<=\w)[。｡](?=\w)", re.I)
_WORDS_AT = re.compile(r"(?<![\w.])([\w.+-]+) (?:at|a c[òo]ng) (\w[\w-]*(?: (?:dot|ch[ấa]m) \w[\w-]*)+)(?!\w)", re.I)
# what each of the three patterns cannot do without; the pattern itself is tried wherever this is found
_NEEDS_AT = re.compile(rf"\s@|@\s|{_OPEN}{_AT_WORD}", re.I)
_NEEDS_DOT = re.compile(rf"{_OPEN}{_DOT_WORD}|[。｡]", re.I)
_NEEDS_WORDS_AT = re.compile(r" (?:dot|ch[ấa]m) ", re.I)
# fixed values: digit words
DIGITS = {
    "không": "0", "khong": "0", "một": "1", "mot": "1", "mốt": "1", "hai": "2", "ba": "3", "bốn": "4", "bon": "4", "tư": "4", "tu": "4", "năm": "5", "nam": "5", "lăm": "5", "lam": "5",
    "sáu": "6", "sau": "6", "bảy": "7", "bẩy": "7", "bay": "7", "tám": "8", "tam": "8", "chín": "9", "chin": "9",
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
_GAP = r"[ \t.,;/–-]+"
_SPELLED = re.compile(rf"(?<!\w)(?:{'|'.join(DIGITS)})(?:{_GAP}(?:{'|'.join(DIGITS)})){{7,}}(?!\w)", re.I)
_BREAKS = bytes.maketrans(b".,;/-", b"     ")
_DIGIT_BYTES = {w.encode() for w in DIGITS}


def _may_spell(low: str) -> bool:
    """Whether eight digit words may follow each other: all but the first and last of them stand between separators, so six
    blank-separated words in a row are digit words. Implied by the pattern, and much quicker to see."""
    words = low.replace("–", " ").encode("utf-8", "surrogatepass").translate(_BREAKS).split()
    return b"\1\1\1\1\1\1" in bytes(map(_DIGIT_BYTES.__contains__, words))


def normalised(source: str) -> Traced:
    t = characters(source)
    if _NEEDS_AT.search(t.text):
        t = t.rewritten(_AT, lambda m: "@")
    if _NEEDS_DOT.search(t.text):
        t = t.rewritten(_DOT, lambda m: ".")
    if _NEEDS_WORDS_AT.search(t.text):
        t = t.rewritten(_WORDS_AT, lambda m: m[1] + "@" + re.sub(r" (?:dot|ch[ấa]m) ", ".", m[2], flags=re.I))
    if _may_spell(t.text.lower()):
        t = t.rewritten(_SPELLED, lambda m: "".join(DIGITS[w.lower()] for w in re.split(_GAP, m.group())))
    return t


def _folded(text: str) -> str:
    """text folded sign by sign, so that positions stay."""
    f = U.fold(text)
    if len(f) == len(text):
        return f
    return "".join(x if len(x := U.fold(c)) == 1 else "?" for c in text)


# ---- identifiers ----
_EMAIL = re.compile(r"(?<![\w.+%@-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+([A-Za-z]{2,})(?![\w@])")
# fixed values: endings of file names, which are no domains
_FILES = {"png", "jpg", "jpeg", "gif", "svg", "bmp", "webp", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "csv", "log", "zip", "json", "xml", "html"}
# fixed values: captions of identity numbers, folded
_ID_CAPTION = (
    r"(?:can cuoc(?: cong dan)?|cccd|cmnd|cmt|chung minh(?: nhan dan| thu)?|ho chieu|passport|giay to(?: kem theo| tuy than)?|so giay to|"
    r"dinh danh(?: ca nhan)?|identity card|id card|(?<![a-z])id)"
)
_ID_BEFORE = re.compile(rf"(?<!\w){_ID_CAPTION}(?:\s*/\s*{_ID_CAPTION})?(?:\s*(?:so|no\.?|number|num|la|is|:|#|=|-))*\s*$")
_ID_VALUE = re.compile(r"(?<![^\W_])(?:[A-Za-z]{1,2}\d{7,8}|\d{3}(?P<s>[ .-]?)\d{3}(?P=s)\d{3}(?:(?P=s)\d{3})?|\d{4}(?P<f>[ .-])\d{4}(?P=f)\d{4})(?!\w)(?![ .-]\d{3}(?![\d.]))")
_S = r"[ .\-]?"
_PHONE = re.compile(
    r"(?<![\w+(/.\-])(?:"
    rf"(?:\(\+84\)|\+84|0084|84){_S}(?:\(0\){_S})?(?:[35789]\d{{2}}{_S}\d{{3}}{_S}\d{{3}}|[35789]\d{_S}\d{{3}}{_S}\d{{2}}{_S}\d{{2}}|2\d{_S}\d{{4}}{_S}\d{{4}}|2\d{{2}}{_S}\d{{3}}{_S}\d{{4}})"
    rf"|(?:\(0[35789]\d{{2}}\)|0[35789]\d{{2}}){_S}\d{{3}}{_S}\d{{3}}|(?:\(0[35789]\d\)|0[35789]\d){_S}\d{{3}}{_S}\d{{4}}|0[35789]\d{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}"
    rf"|(?:\(02\d\)|02\d){_S}\d{{4}}{_S}\d{{4}}|(?:\(02\d{{2}}\)|02\d{{2}}){_S}\d{{3}}{_S}\d{{4}}"
    r")(?!\w)(?![.\-/]\d)(?! \d{3,4}(?![\d.]))"
)
_PHONE_ABROAD = re.compile(
    r"(?<![\w+(/.\-])(?:\+(?!84\D?[2-9])[1-9]\d{0,2}(?:[ .\-]?\(\d{1,4}\))?(?:[ .\-]?\d{2,4}){2,4}|(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[.\-])[2-9]\d{2}[.\-]\d{4})(?!\w)(?![.\-/]\d)"
)
_SOCIAL = re.compile(r"(?<![\w+(/.\-])(?!000|666|9)\d{3}(?P<s>[- ])(?!00)\d{2}(?P=s)(?!0000)\d{4}(?!\w)(?![.\-/]\d)")
_DIGITS_RUN = re.compile(r"\d(?:[ .\-()]{0,2}\d){6,}")
_UNIT_BEHIND = re.compile(r"\s*(?:bytes?|khối|ms|bản ghi|lượt)(?!\w)")

# ---- addresses ----
_TITLE = rf"(?:[{UP}][{LOW}]+|[{UP}]{{2,}})"
_HOUSE = r"\d{1,4}(?:/\d{1,4})*(?:[A-Za-z]|bis|ter)?(?:/\d{1,4}[A-Za-z]?)*"
# fixed values: third syllables of place names
_THIRD = r"(?:Thượng|Hạ|Trung|Đông|Tây|Nam|Bắc|Đoài|Nội|Ngoại|Thuong|Ha|Dong|Tay|Bac|Doai|Noi|Ngoai|THƯỢNG|HẠ|TRUNG|ĐÔNG|TÂY|NAM|BẮC|THUONG|HA)"
# a place has two words, a third that is a direction, or up to four where a mark or the end of the line closes it
_CLOSED = r"(?=[ \t]*(?:[,;)\n]|\.(?:\s|$)|$)|\s[-–]\s)"
_PLACE = rf"{_TITLE}\s{_TITLE}(?:(?: {_TITLE}){{1,2}}{_CLOSED}|\s{_THIRD}(?!\w))?"
_STREET_KIND = r"(?:[đĐ]ường|[pP]hố|[nN]gõ|[nN]gách|[hH]ẻm|[dD]uong|[pP]ho|[nN]go|[hH]em|ĐƯỜNG|PHỐ|NGÕ|DUONG|PHO|Đ\.|D\.|Đg\.)"
_AREA_KIND = r"(?:P\.|Q\.|TP\.|Tp\.|TX\.|TT\.|H\.|X\.|T\.|[pP]hường|[xX]ã|[qQ]uận|[hH]uyện|[tT]hị trấn|[tT]hị xã|[tT]hành phố|[tT]ỉnh|[pP]huong|[xX]a|[qQ]uan|[hH]uyen|[tT]hi tran|[tT]hi xa|[tT]hanh pho|[tT]inh|PHƯỜNG|XÃ|QUẬN|HUYỆN|THÀNH PHỐ|TỈNH)"
_SEP = r"(?:\s*,\s*|\s+[-–]\s+)"
_ENGLISH_STREET = r"(?:Road|Rd\.?|Street|St\.?|Lane|Ln\.?|Avenue|Ave\.?|Drive|Dr\.?|Court|Ct\.?|Square|Sq\.?|Way|Place|Pl\.?|Terrace|Close|Row|Hill|ROAD|STREET|ST\.?|LANE|AVENUE)"
# fixed values: first words of two-word English place names
_FIRST = r"(?:Port|New|Saint|St\.?|Fort|Lake|Mount|North|South|East|West|Old|Great|Upper|Lower|San|Los|Las|El|La|Cape|Point|Bad|PORT|NEW)"
_ENGLISH_PLACE = r"(?:[A-Z][a-z]+ [A-Z][a-z]+" + _CLOSED + r"|(?:" + _FIRST + r"\s)?(?:[A-Z][a-z]+|[A-Z]{3,}))"
_VIETNAMESE_ADDRESS = re.compile(
    rf"(?<![\w/.,-])(?P<house>{_HOUSE}),?\s+(?P<lane>(?:(?:[nN]gõ|[nN]gách|[hH]ẻm|[nN]go|NGÕ|kiệt)\s\d{{1,4}}(?:/\d+)*[A-Z]?,?\s+)*)(?P<kind>{_STREET_KIND}\s*)?(?P<street>{_PLACE}|(?<=\s){_TITLE}(?={_SEP}{_AREA_KIND}))"
    rf"(?P<areas>(?:{_SEP}{_AREA_KIND}\s?{_PLACE})*)(?P<city>{_SEP}{_PLACE}(?!\w))?"
)
_ENGLISH_ADDRESS = re.compile(rf"(?<![\w/.,-])(?P<house>{_HOUSE}),?\s+(?P<street>(?:[A-Z][A-Za-z'’]+\s){{1,3}}{_ENGLISH_STREET})(?P<city>,?\s*,\s*{_ENGLISH_PLACE}|,\s{_ENGLISH_PLACE})?(?!\w)")
_CITY_AREA = re.compile(rf"{_SEP}(?:TP\.|Tp\.|[tT]hành phố|[tT]ỉnh|[tT]hanh pho|[tT]inh|THÀNH PHỐ|TỈNH)\s?{_PLACE}$")
_PLACE_CUE = re.compile(r"(?:(?<![a-z])(?:dia chi|thuong tru|tam tru|tai(?: so)?|o(?: so)?|gui ve|gui den|so|lives at|live at|to|at|address)|[:>|])\s*:?\s*$")

# ---- names: signs are weighed, and a run of words that weighs enough is a name ----
# fixed values: family names, Vietnamese and of the highlands, and middle names
FAMILY = "Nguyễn Trần Lê Phạm Hoàng Huỳnh Phan Vũ Võ Đặng Bùi Đỗ Hồ Ngô Dương Lý Đinh Đoàn Trương Trịnh Mai Đào Lương Lâm Tạ Hà Chu Cao Thái Tô Vương Quách La Lưu Phùng Tống Kiều Thân Triệu Nghiêm Từ Khổng Giang Ninh Mạc Đồng Tôn Bạch Châu Diệp Lại Lục Doãn Ông Âu Trà Cù Nông Hứa Giàng Sùng Vàng Thào Hạng Tẩn Phàn Chảo Lò Lường Quàng Ksor Siu Thạch"  # noqa: E501
MIDDLE = "Văn Thị Hữu Đức Minh Quang Gia Bảo Ngọc Thu Xuân Khắc Đình Công Thanh Hồng Kim Phương Anh Tuấn Hoàng Việt Quốc Trọng Tiến Mạnh Bá Đăng Như Mỹ Bích Thuý Thúy Lan Hải Duy Nhật Trung Thành Hoài Diệu Khánh Huy Tấn Phúc Viết Sỹ Sĩ Danh Thế Mai Tuyết Ánh Cẩm Hà Thái Vĩnh Chí Nam Hùng Phú Tường Trường Cao Đắc Huyền Kiều Lệ Linh Mộng Nguyệt Tú Tuệ Vân Yến Thị A Seo"  # noqa: E501
# fixed values: given names in wide use abroad, and family names of China and Korea
GIVEN = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Kevin Brian George Edward Peter Henry Frank Samuel Jack Alexander Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Emily Anna Emma Maria Laura Julia Alice Helen Rachel Catherine Olivia Sophie Jane Jose Juan Carlos Luis Miguel Pedro Jorge Carmen Sofia Ana Lucia Elena Pierre Jean Marie Claire Hans Klaus Heidi Ivan Olga Sergei Natasha Mohammed Muhammad Ahmed Ali Fatima Omar Hassan Aisha Raj Priya Amit Sunil Anita Ravi Hiroshi Yuki Kenji Akira Sakura Min Jin Wei Li Ming Hui Xin Yan Jing Jun Lei Fang"  # noqa: E501
SURNAME_ABROAD = "Zhang Wang Liu Chen Yang Huang Zhao Wu Zhou Xu Sun Ma Zhu Hu Guo Lin He Gao Luo Kim Park Choi Jung Kang Cho Yoon Jang Lim Han"
_FAMILY = {w.lower() for w in FAMILY.split()}
_FAMILY_PLAIN = {U.fold(w) for w in _FAMILY}
_MIDDLE = {w.lower() for w in MIDDLE.split()}
_MIDDLE_PLAIN = {U.fold(w) for w in _MIDDLE}
_GIVEN, _ABROAD = {w.lower() for w in GIVEN.split()}, {w.lower() for w in SURNAME_ABROAD.split()}
_TOKEN = re.compile(r"[^\W\d_]+")
_EN_WORD = rf"(?:[{UP}]['’])?[{UP}][{LOW}]+(?:[-'’][{UP}][{LOW}]+)?"
_ENGLISH_NAME = re.compile(rf"(?:[{UP}][{LOW}]+(?: [A-Z]\.)* {_EN_WORD}|[A-Z]{{2,}}(?: [A-Z]\.)* [A-Z]{{2,}}(?:[-'’][A-Z]{{2,}})?)(?!\w)")
_INITIAL = re.compile(r" [A-Z]\. ")
# fixed values: what stands before a name, folded
_CUE = re.compile(
    r"(?<![a-z])(?:(?:kinh gui|gui|ong|ba|anh|chi|dong chi|ho (?:va )?ten|ky thay|ky ten|nguoi (?:lap|ky|gui|nhan|duyet|lien he|phu trach|dai dien)|nguoi_lap|nguoi giu chia khoa|y kien cua|trao doi voi|thao luan voi|lam viec voi|"
    r"dau moi|lien he|lien lac voi|gap|gom|chu tri|thu ky|can bo|nhan vien|giam doc|truong phong|from|contact|call|ask|meet|prepared by|reviewed by|approved by|signed by|written by|attn|attention|dear|regards|sincerely|mr|mrs|ms|miss|dr|prof|name|id [a-z]?[\d .-]{7,16} for|"
    r"ngay \d{1,2}/\d{1,2})(?![a-z])(?:\s*[:=,]|(?<=mr)\.|(?<=ms)\.|(?<=mrs)\.|(?<=dr)\.|(?<=prof)\.)?\s*(?:(?:ong|ba|anh|chi|mr|mrs|ms|dr)(?![a-z])\.?\s+)?)$"
)
_LIST = re.compile(r" *(?:[,;&]| (?:va|và|VÀ|and)) +")
_WORD = rf"[{UP}][{UP}{LOW}]*"
_RUN = re.compile(rf"[{UP}](?<![^\W_].)[{UP}{LOW}]* (?:{_WORD}(?:[-'’]{_WORD})?|[A-Z]\. {_WORD})(?: {_WORD})*")
_HONORIFIC = re.compile(r"(?:\bMr|\bMrs|\bMs|\bDr|\bProf|\bMiss|\bContact|\bCall|\bAsk|\bFrom|\bDear|\bÔng|\bBà|\bAnh|\bChị|\bCô|\bChú)\.? $")
_HOUSE_AHEAD = re.compile(rf"\d(?<![\w/.,-].)(?=\d{{0,3}}(?:/\d{{1,4}})*(?:[A-Za-z]|bis|ter)?(?:/\d{{1,4}}[A-Za-z]?)*,?\s+(?:[{UP}]|đường|phố|ngõ|ngách|hẻm|duong|pho|ngo|hem|kiệt|đ|d|p|n))")
# fixed values: what stands behind a name
_BEHIND = re.compile(r"\s+(?:said|says|lives at|wrote|asked|confirmed|đã xác nhận)(?!\w)|\s*<[^<>\s]{3,}|\s*</td>|\s+\|\s|\s*\(cc|\s+-\s+(?=[(+]?\d{2,})")
# fixed values: words before, and behind, what looks like a name but is a place or a firm, folded
_NO_NAME = re.compile(r"(?<![a-z])(?:duong|pho|ngo|ngach|hem|phuong|xa|quan|huyen|thanh pho|tinh|khu vuc|khu|cong ty|trung tam|tap doan|ngan hang|truong|benh vien|cau|cho|ho so|du an|he thong|[pqdđ]\.|tp\.|ha tang|van hanh) *\Z")
_NO_NAME_BEHIND = re.compile(r"[ ,]+(?:Ltd|Inc|LLC|Corp|Company|Group|Bank|Street|St|Road|Lane|Avenue|Server|System|Center|Centre|University|Hospital)\b")
# fixed values: words of speech that begin sentences and are family names too
_ORDINARY = {"he", "ma", "wei", "min", "li", "jun", "jin", "park", "sun", "lin", "han", "mark", "frank", "jack"}
NAME_WEIGHS = 3.0
# fixed values: weights. A known family name, middle name, given name, an initial; a cue before, one behind; a word before
# or behind that makes it a place or a firm; the shape of a Vietnamese or an English name
W_FAMILY, W_MIDDLE, W_GIVEN, W_SURNAME, W_INITIAL, W_CUE, W_BEHIND, W_NO_NAME, W_SHAPE = 2.0, 1.0, 2.5, 1.0, 3.0, 2.5, 2.5, -2.5, 0.5
#: A Vietnamese syllable: onset, vowels, coda. Fixed values of the spelling.
_SYLLABLE = re.compile(r"(?:ngh|ng|nh|gh|gi|kh|ph|th|tr|ch|qu|[bcdđghklmnprstvx])?[aeiouyăâêôơư]{1,3}(?:ng|nh|ch|[cmnpt])?")


def _style(w: str) -> str:
    if len(w) > 1 and w.isupper():
        return "upper"
    return "title" if w[0].isupper() and (len(w) == 1 or w[1:].islower()) else ""


def _is(w: str, exact: set, plain: set) -> bool:
    low = unicodedata.normalize("NFC", w.lower())
    return low in exact or (low.isascii() and low in plain)


def _is_family(w: str) -> bool:
    return _is(w, _FAMILY, _FAMILY_PLAIN)


def _is_middle(w: str) -> bool:
    return _is(w, _MIDDLE, _MIDDLE_PLAIN)


def _syllabic(w: str) -> bool:
    """Whether the word is spelled like one Vietnamese syllable (tones aside)."""
    plain = "".join(c for c in unicodedata.normalize("NFD", w.lower()) if c not in "̣̀́̃̉")
    return bool(_SYLLABLE.fullmatch(unicodedata.normalize("NFC", plain)))


def _words_at(text: str, at: int) -> list[re.Match]:
    """Up to five words in one style, a single blank between them."""
    toks, pos, style = [], at, None
    while len(toks) < 5:
        m = _TOKEN.match(text, pos)
        if not m or not (s := _style(m.group())) or (style and s != style and len(m.group()) > 1):
            break
        style = style or s
        toks.append(m)
        if text[m.end() : m.end() + 1] != " ":
            break
        pos = m.end() + 1
    return toks


def vietnamese_name(text: str, at: int, cued: bool) -> tuple[int, float] | None:
    """(end, weight) of the name that begins at `at`: a family name, up to three middle names and a given name in one style.
    Behind a cue the family name may be any syllable; then the name is what stands there, four words at most."""
    first = _TOKEN.match(text, at)
    if not cued and not (first and _is_family(first.group())):
        return None
    toks = _words_at(text, at)
    if len(toks) < 2:
        return None
    if not _is_family(toks[0].group()):
        if not cued or not all(_syllabic(m.group()) for m in toks[:4]):
            return None
        return toks[min(len(toks), 4) - 1].end(), W_CUE + W_SHAPE
    k = 1
    while k < len(toks) - 1 and k < 4 and _is_middle(toks[k].group()):
        k += 1
    weight = W_FAMILY + W_MIDDLE * (k - 1) + (W_CUE if cued else 0.0)
    if k == 1 and len(toks) > 2 and cued:  # an unknown middle name: taken along if the name would else have two words
        k = 2 if text[toks[2].end() : toks[2].end() + 1] != " " or len(toks) == 3 else 1
    return toks[k].end(), weight


def foreign_name(text: str, at: int, cued: bool, first: bool) -> tuple[int, float] | None:
    """(end, weight) of a name in the English order: given name, initials, family name (or, in East Asia, the other way)."""
    m = _ENGLISH_NAME.match(text, at)
    if not m:
        return None
    parts = re.split(r"[ ]", m.group())
    weight = W_SHAPE + (W_CUE if cued else 0.0)
    a, z = parts[0].lower(), parts[-1].lower()
    if len(parts) == 2 and (a not in _ORDINARY or z in _ABROAD or z in _GIVEN):
        weight += W_GIVEN if a in _GIVEN else W_GIVEN if a in _ABROAD and z in _GIVEN else 0.0
        weight += W_SURNAME if z in _ABROAD else 0.0
    elif a in _GIVEN:
        weight += W_GIVEN
    if _INITIAL.search(m.group()):
        weight += W_INITIAL
    if first and not _is_family(parts[0]) and _BEHIND.match(text, m.end()):
        weight += W_BEHIND
    if _NO_NAME_BEHIND.match(text, m.end()):
        weight += 2 * W_NO_NAME
    return m.end(), weight


# names written without capitals: common family names, with what each weighs there (the bare forms are words, too)
_LOWER = {"nguyễn": 2.5, "nguyen": 2.5, "trần": 2.0, "tran": 1.5, "phạm": 2.0, "pham": 2.0, "huỳnh": 2.0, "huynh": 1.5, "hoàng": 2.0, "đặng": 2.0, "bùi": 2.0, "vũ": 2.0, "võ": 2.0, "đỗ": 2.0, "lê": 2.0}
_LOWER_WEIGHS = 3.5
_LOWER_TOKEN = re.compile(rf"[{LOW}]+")


def lower_names(text: str) -> Iterator[tuple[int, int]]:
    """Spans of names in small letters: a common family name, known middle names and one more word; a cue adds its weight."""
    for f, weight in _LOWER.items():
        at = text.find(f + " ")
        while at >= 0:
            if at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_"):
                pos, middles, last = at + len(f) + 1, 0, None
                while m := _LOWER_TOKEN.match(text, pos):
                    if m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] == "_"):
                        break
                    last = m
                    if middles >= 3 or not _is_middle(m.group()) or text[m.end() : m.end() + 1] != " ":
                        break
                    middles, pos = middles + 1, m.end() + 1
                if middles and last is not None and last.start() >= pos:
                    first = text[at + len(f) + 1 :].split(" ", 1)[0]
                    w = weight + middles * W_MIDDLE + (0.5 if first in ("văn", "van", "thị", "thi") else 0.0)
                    if w < _LOWER_WEIGHS and _CUE.search(_folded(text[max(0, at - 48) : at])):
                        w += W_CUE
                    if w >= _LOWER_WEIGHS:
                        yield at, last.end()
            at = text.find(f + " ", at + 1)


def detect(t: Traced) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the identifiers in the normalised text, in order and without overlaps. Each kind is looked for
    only around the few places that can hold it: at signs, long runs of digits, house numbers, runs of capitalised words."""
    text = t.text
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def add(a: int, b: int, kind: str) -> bool:
        i = bisect(taken, (a, b))
        if b <= a or (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
            return False
        taken.insert(i, (a, b))
        found.append((a, b, kind))
        return True

    if "@" in text:
        for m in _EMAIL.finditer(text):
            if m[1].lower() not in _FILES:
                add(m.start(), m.end(), "email")
    for d in _DIGITS_RUN.finditer(text):
        lo, hi = max(0, d.start() - 3), d.end() + 24
        for m in _ID_VALUE.finditer(text, lo, min(len(text), hi)):
            if _ID_BEFORE.search(_folded(text[max(0, m.start() - 48) : m.start()])):
                add(m.start(), m.end(), "id_number")
        for m in _SOCIAL.finditer(text, lo, min(len(text), hi)):
            add(m.start(), m.end(), "id_number")
        for pattern in (_PHONE, _PHONE_ABROAD):
            for m in pattern.finditer(text, lo, min(len(text), hi)):
                if m.end() < hi and not _UNIT_BEHIND.match(text, m.end()):
                    add(m.start(), m.end(), "phone")
    for h in _HOUSE_AHEAD.finditer(text):
        if m := _ENGLISH_ADDRESS.match(text, h.start()):
            add(m.start(), m.end(), "address")
        elif m := _VIETNAMESE_ADDRESS.match(text, h.start()):
            if m["kind"] or m["lane"] or m["areas"] or (m["city"] and _PLACE_CUE.search(_folded(text[max(0, m.start() - 20) : m.start()]))):
                end = m.end()
                if m["city"] and _CITY_AREA.search(m["areas"] or ""):  # the areas end with a town: nothing follows it
                    end = m.start("city")
                add(m.start(), end, "address")

    last = -1  # the end of the last name that a cue led to
    for r in _RUN.finditer(text):
        a, b = r.span()
        p = a
        while p < b:
            w = _TOKEN.match(text, p)
            nxt = (w.end() if w else p) + 1
            before = text[max(0, p - 48) : p] if p == a or _HONORIFIC.search(text, a, p) else ""
            m = _CUE.search(_folded(before)) if before else None
            if m and m.group().split() and m.group().split()[-1] == "ba" and "bà" not in before[m.start() :].lower() and not before.isascii():
                m = None  # the number three in an accented text
            cued = (bool(m) and not before[m.start() : m.end()].isupper()) or (last > 0 and p == a and bool(_LIST.fullmatch(text, last, a)))
            best = None
            for got in (vietnamese_name(text, p, cued) if w else None, foreign_name(text, p, cued, p == a)):
                if not got or got[1] < NAME_WEIGHS:
                    continue
                place = p == a and not cued and bool(_NO_NAME.search(_folded(text[max(0, p - 24) : p])))
                if got[1] + (W_NO_NAME if place else 0.0) >= NAME_WEIGHS:
                    best = got[0]
                    break
            if best is not None and add(p, best, "name"):
                last = best if cued else -1
                p = best + 1
                continue
            p = max(nxt, p + 1)
    for a, b in lower_names(text):
        add(a, b, "name")
    if "(" in text:  # the holder of a paper, in brackets behind its number
        for a, b, kind in list(found):
            if kind == "id_number" and text[b : b + 2] == " (":
                got = vietnamese_name(text, b + 2, True) or foreign_name(text, b + 2, True, False)
                if got is not None:
                    add(b + 2, got[0], "name")
    return sorted(found)


def findings(source: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) in the source text."""
    t = normalised(source)
    out = []
    for a, b, kind in detect(t):
        s, e = t.start[a], t.end[b - 1]
        out.append((kind, s, e, source[s:e]))
    return out


FOUND = T.StructType(
    [
        T.StructField("redacted", T.StringType()),
        T.StructField("found", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())]))),
    ]
)


def _redact(source: str) -> tuple[str, list]:
    got = findings(source)
    out, last = [], 0
    for kind, s, e, _ in got:
        out += [source[last:s], PLACEHOLDER[kind]]
        last = e
    return "".join(out) + source[last:], got


@F.pandas_udf(FOUND)
def _personal(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        rows = [(None, None) if t is None else _redact(t) for t in s]
        yield pd.DataFrame({"redacted": [r[0] for r in rows], "found": [None if r[1] is None else [dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in r[1]] for r in rows]}, dtype=object)


def personal_data(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `redacted` (the text with typed placeholders) and `found` (kind, start, end, value; code points of the source).

    Null texts give nulls, empty ones the empty text and no findings; texts of any length are read whole; repeated rows are
    treated each; columns called redacted or found are replaced. Where findings overlap the first kind of email, id_number, phone, address, name holds. No shuffle."""
    keep = [c for c in df.columns if c not in ("redacted", "found")]
    row = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(1).alias("_"))
    out = df.select(row.alias("row"), _personal.asNondeterministic()(F.col(text)).alias("pd"))
    return out.select(*(["row.*"] if keep else []), "pd.redacted", "pd.found")


def _documents(spark, folder: str) -> DataFrame:
    from sizelake.sources.tables import table

    return table(spark, folder, "documents").select("doc_id", "text")


def p8_found(spark, folder: str) -> DataFrame:
    found = personal_data(_documents(spark, folder).where(F.length("text") > 0)).select("doc_id", F.explode(F.array_distinct(F.transform("found", lambda x: F.struct(x["kind"], x["value"])))).alias("x"))
    return found.select("doc_id", "x.kind", "x.value").distinct()


def p8_redacted(spark, folder: str) -> DataFrame:
    return personal_data(_documents(spark, folder)).select("doc_id", "redacted")
