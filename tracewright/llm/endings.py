"""How a text ends, and which part of it is the answer.

Plain functions over one text, used by the truncation and the pair checks.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from tracewright.llm.fold import fold

# Marks around reasoning and solution in model outputs.
_OPEN = re.compile(r"<(?:[tT][hH][iI][nN][kK]>|\|[bB][eE][gG][iI][nN]_[oO][fF]_[tT][hH][oO][uU][gG][hH][tT]\|>)")
_CLOSE = re.compile(r"<(?:/[tT][hH][iI][nN][kK]>|\|[eE][nN][dD]_[oO][fF]_[tT][hH][oO][uU][gG][hH][tT]\|>)")
_SOLUTION = re.compile(r"<\|(?:begin|end)_of_solution\|>", re.I)

_BRACKET_MARK = re.compile(r"[\[(<]\|?\s*(?:…|\.{3}|truncated|cut off|cut|clipped|abgeschnitten|gekürzt|tronqué|coupé|truncado|cortado)[^\])>]*\|?[\])>]", re.I)
_DOTS = re.compile(r"(?:…|\.{3,}|�)+$")
_SURE_MARK = re.compile(r"�|truncat|cut|clipped|abgeschn|gekürzt|tronqu|coupé|truncad|cortado", re.I)
_TAG_PIECE = re.compile(r"<(?:[/|]{0,2}[A-Za-z_][\w|]*|[</|]*)$")
_COMMAND_PIECE = re.compile(r"\\[A-Za-z]*$")
_NUMBERING = re.compile(r"\s*\d{1,3}[.)]$")
_HANGING = frozenset(",;:([{=+−×÷/&-–—<~^_$")
_QUOTES = "»”’\"'|"
_SENTENCE = re.compile(r"""(?:[^\W\d_]{3}|[^\W\d_] \S{0,20}\d)[.!?][»”’"'*)\]]*\s""")
_NUMBER = re.compile(r"\d+")
_LABEL = re.compile(r"^([^:]{1,80}):\s*[-−]?\d[\d.,]*\s*([^\d.!?:;,]*)$")


class Ending(NamedTuple):
    """How a text ends.

    ``state`` is blank, cut, closed (final punctuation, closed formula or tag)
    or open.  ``tail`` is the last line with numbers masked; of an open line
    ``label: number unit`` only the unit, after ``LABELLED``.  ``chars`` and
    ``octets`` measure the text without a trailing mark of the cut.
    """

    state: str
    tail: str | None
    chars: int
    octets: int
    #: an open text of which an earlier sentence of the same part ends with punctuation
    punctuated: bool = False


LABELLED = "\x01"


class Parts(NamedTuple):
    reasoning: str | None
    answer: str | None
    #: reasoning was begun and never ended
    unfinished: bool


def parts(text: str) -> Parts:
    """Reasoning and answer of a response; the answer is null where reasoning was begun and never ended."""
    close = _CLOSE.search(text)
    opened = _OPEN.search(text)
    if close:
        inner = text[opened.end() if opened and opened.end() <= close.start() else 0 : close.start()]
        return Parts(inner, _SOLUTION.sub("", text[close.end() :]), False)
    if opened:
        return Parts(text[opened.end() :], None, True)
    return Parts(None, _SOLUTION.sub("", text), False)


def without_marks(body: str) -> tuple[str, str]:
    """A text and the marks of a cut (dots, a broken character, a remark in brackets) at its end."""
    core = body.rstrip()
    at = len(core)
    while at:
        if core[at - 1] in "])>":
            # the nearest bracket that opens; a remark holds none itself
            begin = max(core.rfind(c, 0, at) for c in "[(<")
            if begin < 0 or not _BRACKET_MARK.fullmatch(core, begin, at):
                break
        elif core[at - 1] in ".…�":
            begin = at
            while begin and core[begin - 1] in ".…�":
                begin -= 1
            piece = core[begin:at]
            found = _DOTS.search(piece)
            if not found:
                break
            begin += found.start()
        else:
            break
        at = begin
        while at and core[at - 1].isspace():
            at -= 1
    return core[:at], core[at:]


def is_closed(core: str) -> bool:
    """Final punctuation, a closing bracket or tag, with quotation marks after it."""
    plain = core.rstrip("*_` ")
    bare = plain.rstrip(_QUOTES + " \t\n")
    return bare[-1:] in tuple(".!?。)]}" if len(bare) < len(plain) else ".!?。)]}>") and bool(bare)


def breaks_off(core: str) -> bool:
    """The end is the piece of a tag, formula, command, list or emphasis, or hangs on a mark."""
    line = core[core.rfind("\n") + 1 :]
    tag, command = core.rfind("<"), core.rfind("\\")
    return bool(
        (tag >= 0 and _TAG_PIECE.match(core, tag))
        or (command >= 0 and _COMMAND_PIECE.match(core, command))
        or line.count("{") > line.count("}")
        or core.rfind("\\[") > core.rfind("\\]")
        or _NUMBERING.match(line)
        or line.count("**") % 2
        or core.rstrip("*_` ")[-1:] in _HANGING
    )


def ending(text: str, folded: str | None = None) -> Ending:
    """How the text ends, judged from itself alone, over its whole length; ``folded`` if it is at hand."""
    body = (fold(text) if folded is None else folded).rstrip()
    core, mark = without_marks(body)
    chars, octets = len(text), len(text.encode())
    if mark:
        plain = text.rstrip()
        lost = len(body) - len(core)
        chars, octets = len(plain) - lost, len(plain[: len(plain) - lost].encode())
    if not core:
        return Ending("blank", None, chars, octets)
    closed = is_closed(core)
    if (mark and (_SURE_MARK.search(mark) or not closed)) or breaks_off(core):
        return Ending("cut", None, chars, octets)
    line = core[core.rfind("\n") + 1 :]
    masked = _NUMBER.sub("#", line.casefold())
    if closed:
        return Ending("closed", masked, chars, octets)
    part = parts(text)
    if part.unfinished:
        return Ending("cut", None, chars, octets)
    label = _LABEL.match(line.replace("*", "").strip())
    if label:
        return Ending("open", LABELLED + label.group(2).strip().casefold(), chars, octets)
    return Ending("open", masked, chars, octets, _SENTENCE.search((part.answer or "").rstrip()) is not None)
