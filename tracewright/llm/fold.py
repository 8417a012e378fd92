"""One form for characters that look alike.

Three kinds of change are undone, each one-to-one per character so that the
JVM ``translate`` expression and ``str.translate`` agree:

* full-width ASCII (U+FF01-FF5E) to ASCII,
* letters of other scripts that are drawn like Latin letters,
* blanks of any width to the ordinary space.

Characters that show nothing are dropped.  Composed and decomposed accents are
made equal by the ``UNICODE`` collation in SQL and by NFC in Python.  Raised
figures, fractions, case, accents and styled letters (bold, script, double
struck) stay, since a reader sees them.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters drawn like a Latin letter, by script (public Unicode
# security data, "confusables").
_CYRILLIC = (
    "АВЕЅІЈКМНОРСТУХҮԌԚԜаеорсухѕіјһӏԁԛԝӀѴѵү",
    "ABESIJKMHOPCTYXYGQWaeopcyxsijhldqwIVvy",
)
_GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορυνγιϲϳͿϹϺϜ", "ABEZHIKMNOPTYXaopuvyicjJCMF")
_LATIN_ARMENIAN = ("ɡɑıօհոսցԁՕՏՍᴄᴏᴠᴡᴢꜱ", "gaiohnugdOSUcovwzs")
_COPTIC = ("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "HIKMNOPCTYXopc")
_CHEROKEE = ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏔᏕᏙᏚᏞᏟᏢᏦᏴᏏᏒᏧᏂᎥᎩ", "DRTAJEWMHYGZWSVSLCPKBbRdhiY")
_LISU = ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU")
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

PAIRS: dict[str, str] = {}
for _a, _b in (_CYRILLIC, _GREEK, _LATIN_ARMENIAN, _COPTIC, _CHEROKEE, _LISU):
    PAIRS.update(zip(_a, _b, strict=True))
# numerals that are one letter, full-width forms and signs
PAIRS.update({chr(c): n for c in range(0x2160, 0x2180) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii()})
PAIRS.update({chr(c): n for c in range(0xFFE0, 0xFFE7) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1})
PAIRS.update({chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)})
PAIRS.update({chr(c): " " for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Zs"})

#: Characters that show nothing: format characters, variation selectors,
#: fillers and controls other than tab and line ends.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180f\u3164\uffa0\ufe00-\ufe0f\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u0084\u0086-\u009f"
_CF = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"]
# Two classes, since one that goes beyond the basic plane is searched far more slowly.
_INVISIBLE_PY = re.compile(f"[{INVISIBLE}{''.join(chr(c) for c in _CF if c <= 0xFFFF)}]+")
_INVISIBLE_HIGH = re.compile(f"[{''.join(chr(c) for c in _CF if c > 0xFFFF)}]+")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+")
_HIGH = re.compile("[\U00010000-\U0010ffff]")
_SUSPECT = re.compile("[" + "".join(PAIRS) + "".join(LIGATURES) + "]")
_TRANSLATE = {ord(a): b for a, b in PAIRS.items()} | {ord(a): b for a, b in LIGATURES.items()}

# Accented letters to their base letter, for the coarse key.
_BASE = {}
for _c in (*range(0xC0, 0x2000), 0x2126, 0x212A, 0x212B):
    _n = unicodedata.normalize("NFD", chr(_c))
    if _n != chr(_c) and (len(_n) == 1 or unicodedata.combining(_n[1])):
        _BASE[chr(_c)] = PAIRS.get(_n[0], _n[0])

_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|small|mark|sub|sup|font|a|code)(?:\s[^<>]*)?/?>", re.I)
_BLOCK = re.compile(r"</?(?:p|br|div|li|ul|ol|td|tr|table|h[1-6]|hr|html|body|head|blockquote|pre|section)(?:\s[^<>]*)?/?>", re.I)


def fold(text: str) -> str:
    """Python twin of :func:`fold_column`, with NFC; for Arrow batches."""
    if text.isascii():
        return _CONTROL.sub("", text) if _CONTROL.search(text) else text
    if _SUSPECT.search(text):
        text = text.translate(_TRANSLATE)
    if _INVISIBLE_PY.search(text):
        text = _INVISIBLE_PY.sub("", text)
    if _HIGH.search(text):
        text = _INVISIBLE_HIGH.sub("", text)
    return unicodedata.normalize("NFC", text)


def strip_markup(text: str) -> str:
    """Folded text without HTML tags, entities, emphasis marks and dollar signs."""
    if "&" in text:
        text = html.unescape(text)
    text = fold(text)
    if "<" in text:
        text = _BLOCK.sub("\n", _INLINE.sub("", text))
    return text


def _java_class(chars: str) -> str:
    return "".join(c if c == "-" else f"\\u{ord(c):04x}" for c in chars)


_INVISIBLE_JAVA = f"\\p{{Cf}}{_java_class(INVISIBLE)}"
# A few ranges that hold every character above: Java tries the members of a
# class one after the other, so a class of single characters is slow.
_MAYBE_JAVA = (
    r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\xad\u0131\u0180-\u1eff\u2000-\u200f\u2028-\u202f\u205f-\u206f"
    r"\u2160-\u217f\u2c80-\u2cff\ua4d0-\ua4ff\ua731\u3000\u3164\ufb00-\ufb06\ufe00-\ufe0f\ufeff-\uffff\x{110bd}-\x{e0fff}]"
)
_ACCENTS_JAVA = r"[\xc0-\u1fff\u20d0-\u20ff\u2126-\u212b\uac00-\ud7a3]"


def fold_column(text: Column) -> Column:
    """Look-alikes, full-width forms and blanks mapped; invisible ones dropped.

    A text without any such character passes as it is, after one search.
    """
    out = F.translate(text, "".join(PAIRS), "".join(PAIRS.values()))
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(text.rlike(_MAYBE_JAVA), F.regexp_replace(out, f"[{_INVISIBLE_JAVA}]+", "")).otherwise(text)


def blind_column(folded: Column) -> Column:
    """Without accents: equal for all folded texts that the collation calls equal."""
    blind = F.regexp_replace(F.translate(folded, "".join(_BASE), "".join(_BASE.values())), "[\\p{M}\\u1100-\\u11ff\\uac00-\\ud7a3]+", "")
    return F.when(folded.rlike(_ACCENTS_JAVA), blind).otherwise(folded)
