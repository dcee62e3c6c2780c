"""Character forms: what is invisible, which widths and look-alikes a character has.

The tables below are fixed values of the Unicode standard's confusable and width data, limited to signs that are drawn
alike in common fonts. Signs that a reader can tell apart (superscripts, circled digits, accents) are not folded.
"""

from __future__ import annotations

import re
import unicodedata

# fixed values: characters that are drawn as nothing
INVISIBLE = "\u00ad\u034f\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
# fixed values: blanks of any width
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# fixed values: letters of other scripts and what they look like in Latin
CYRILLIC_AS_LATIN = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅԌԚԜ", "aeopcyxijshdqwABEKMHOPCTYXIJSGQW", strict=True))
GREEK_AS_LATIN = dict(zip("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oABEZHIKMNOPTYX", strict=True))
# fixed values: small Greek letters that pass for Latin ones within a word, though a reader can tell them apart alone
GREEK_IN_WORDS = dict(zip("αγικνρυχ", "ayikvpux", strict=True))
ARMENIAN_AS_LATIN = dict(zip("ոսօհցյզՍՕՏԼ", "nuohgjqUOSL", strict=True))
CHEROKEE_AS_LATIN = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏚᏙᏞᏟᏢᏦᏴᏀ", "DRTiAJEWMHGZSVLCPKBG", strict=True))
# fixed values: capital eth and African d are drawn as the Vietnamese d with stroke
LATIN_TWINS = {"Ð": "Đ", "Ɖ": "Đ"}

FULLWIDTH = {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
#: Letters and digits in another style (mathematical alphabets, Roman numerals, ligatures), by the standard's own compatibility
#: forms; signs that say more than their letters (superscripts, circled ones, fractions, units) are not among them.
STYLED = {
    chr(c): form
    for a, b in ((0x1D400, 0x1D7FF), (0x2160, 0x217F), (0xFB00, 0xFB06), (0x2102, 0x2134))
    for c in range(a, b + 1)
    if (form := unicodedata.normalize("NFKC", chr(c))) != chr(c) and form.isalnum() and ("<font>" in unicodedata.decomposition(chr(c)) or c in range(0x2160, 0x2180) or c >= 0xFB00 and c < 0x10000)
}
LOOKALIKES = CYRILLIC_AS_LATIN | GREEK_AS_LATIN | GREEK_IN_WORDS | ARMENIAN_AS_LATIN | CHEROKEE_AS_LATIN
LATIN_AS_CYRILLIC = {v: k for k, v in CYRILLIC_AS_LATIN.items()}
LATIN_AS_GREEK = {v: k for k, v in (GREEK_IN_WORDS | GREEK_AS_LATIN).items()}

_BASE = str.maketrans({c: None for c in INVISIBLE} | {c: " " for c in SPACES} | FULLWIDTH | LATIN_TWINS | STYLED)
_TO_LATIN = str.maketrans(LOOKALIKES)
_TO_CYRILLIC = str.maketrans(LATIN_AS_CYRILLIC)
_TO_GREEK = str.maketrans(LATIN_AS_GREEK)

#: Java class of what the base form may change: anything but ASCII and precomposed Latin letters (without the twins).
DIRTY = r"[^\x00-\x7f\u00c0-\u00cf\u00d1-\u0188\u018a-\u02af\u1e00-\u1eff\u2013\u2014\u2018-\u201d\u2026]"
#: Letters of the other scripts that the repair looks at.
FOREIGN = r"[\u0370-\u03ff\u0400-\u058f\u13a0-\u13ff\uab70-\uabbf\u1f00-\u1fff]"


def base_form(s: str) -> str:
    """Invisible signs out, blanks and full-width forms to their plain twins, accents composed. Case, line ends and runs of
    blanks stay."""
    return s if s.isascii() else unicodedata.normalize("NFC", s.translate(_BASE))


def as_latin(s: str) -> str:
    """Look-alikes of other scripts as Latin; decomposed first, as a foreign letter may carry the accent."""
    return s if s.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(_TO_LATIN))


def as_cyrillic(s: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(_TO_CYRILLIC))


def as_greek(s: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(_TO_GREEK))


def script(c: str) -> str:
    """latin, cyrillic, greek, armenian, cherokee or '' for any other sign. c is a single decomposed character."""
    o = ord(c)
    if 0x530 <= o <= 0x58F:
        return "armenian"
    if 0x13A0 <= o <= 0x13FF or 0xAB70 <= o <= 0xABBF:
        return "cherokee"
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return "greek"
    if 0x400 <= o <= 0x52F:
        return "cyrillic"
    return "latin" if c.isalpha() and (o < 0x250 or 0x1E00 <= o <= 0x1EFF) else ""


_MARKS = re.compile("[\u0300-\u036f]")


def fold(s: str) -> str:
    """For matching only: plain lower-case Latin without accents, from any of the forms above."""
    if s.isascii():
        return s.lower()
    s = unicodedata.normalize("NFD", s.translate(_BASE)).translate(_TO_LATIN)
    return _MARKS.sub("", s).replace("đ", "d").replace("Đ", "D").lower()
