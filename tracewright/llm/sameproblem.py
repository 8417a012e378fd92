"""Comparison of two problem texts, word by word.

A text is read as words (numbers are words too).  For the search it becomes a
string over words that does not depend on the order of its sentences: its
numbers in rising order, each with the words next to it, or, of a text with
few numbers, all its words, sentence after sentence in sorted order.  The exact
check afterwards compares the whole texts as bags of words: quantities must be
equal, what is left over on either side must be explained by slips of the pen,
changed wording or added framing, and no name may differ.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np

from tracewright.llm.fold import strip_markup

_NOTES = re.compile(r"(?im)^[ \t]*#{1,6}[ \t]*notes?\b")
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.?!:;…]|\n")
#: Words on each side of a number that belong to it.
REACH = 1
#: Texts with fewer numbers are searched by all their words.
MIN_NUMBERS = 3
#: Words of a search string for each edit: less than a third of the words around numbers may change, less than a fifth of all words.
WORDS_PER_EDIT = {True: 2 * REACH + 1, False: 5}

# Names of the languages an answer may be asked for in.
LANGUAGE_NAMES = frozenset(
    "english german french spanish englisch deutsch französisch spanisch anglais allemand français espagnol inglés alemán francés español".split()
)


@dataclass(frozen=True)
class Problem:
    """Words of a text; ``name`` marks those with a capital inside a sentence."""

    words: tuple[str, ...]
    name: tuple[bool, ...]
    cased: bool
    stops: int
    #: words that begin a sentence
    begins: tuple[bool, ...] = ()

    @property
    def numbers(self) -> list[str]:
        return sorted((w for w in self.words if w.isdecimal()), key=lambda w: (len(w), w))


def problem_text(text: str) -> str:
    """Folded text without markup and without the block of notes."""
    text = strip_markup(text)
    note = _NOTES.search(text)
    return text[: note.start()].strip() if note else text.strip()


def parse(text: str) -> Problem:
    """Parse the outcome of :func:`problem_text`."""
    words, name, starts, capitals, letters, inner, last = [], [], [], 0, 0, 0, 0
    for m in _WORD.finditer(text):
        w = m.group()
        begins = last == 0 or _END.search(text, last, m.start()) is not None
        inner += begins and last > 0
        starts.append(begins)
        words.append(w.casefold())
        letters += w[0].isalpha()
        capitals += w[0].isupper()
        name.append(w[0].isupper() and not begins)
        last = m.end()
    cased = bool(capitals) and capitals <= 0.6 * letters
    return Problem(tuple(words), tuple(name) if cased else (False,) * len(words), cased, inner, tuple(starts))


def search_string(p: Problem, reach: int = REACH) -> tuple[bool, list[str]]:
    """Numbers in rising order with the words around them (true), or all words by sorted sentences (false)."""
    at = [i for i, w in enumerate(p.words) if w.isdecimal()]
    if len(at) < MIN_NUMBERS:
        cuts = [i for i, b in enumerate(p.begins) if b and i]
        sentences = sorted(p.words[i:j] for i, j in zip([0, *cuts], [*cuts, len(p.words)], strict=True))
        return False, [w for x in sentences for w in x]
    padded = ("",) * reach + p.words + ("",) * reach
    near = sorted((padded[i : i + 2 * reach + 1] for i in at), key=lambda x: (len(x[reach]), x[reach], x))
    return True, [w for x in near for w in x]


def edits(words: int, numeric: bool) -> int:
    """Edits that a search string of so many words may have."""
    return max(words - 1, 0) // WORDS_PER_EDIT[numeric]


def banded_distances(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """Edit distance of each row of ``a`` (all of one length) to the first ``lengths`` codes of that row of ``b``, or k + 1 if it is above k.

    The banded dynamic programme of all rows at once; codes are above 0.
    """
    rows, n = a.shape
    far = k + 1
    width = max(n + 2 * k + 1, b.shape[1] + 2 * k + 1)
    padded = np.zeros((rows, width), dtype=b.dtype)
    padded[:, k + 1 : k + 1 + b.shape[1]] = b
    shift = np.arange(2 * k + 1)
    # column d of a row stands for place i + d - k of b
    row = np.broadcast_to(np.where(shift < k, far, shift - k), (rows, 2 * k + 1)).astype(np.int32)
    for i in range(1, n + 1):
        change = row + (padded[:, i : i + 2 * k + 1] != a[:, i - 1 : i])
        change[:, :-1] = np.minimum(change[:, :-1], row[:, 1:] + 1)
        row = np.minimum(np.minimum.accumulate(change - shift, axis=1) + shift, far).astype(np.int32)
    at = lengths - n + k
    out = np.full(rows, far)
    inside = (at >= 0) & (at <= 2 * k)
    out[inside] = row[np.flatnonzero(inside), at[inside]]
    return out


def slip(a: str, b: str) -> bool:
    """One letter dropped, doubled, changed or two neighbours swapped, or two such slips in a long word."""
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 3:
        return False
    limit = 1 if min(len(a), len(b)) < 8 else 2
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            cur.append(d)
        prev2, prev = prev, cur
    return prev[-1] <= limit


def _unmatched(a: Problem, b: Problem) -> tuple[Counter, Counter]:
    ca, cb = Counter(a.words), Counter(b.words)
    return ca - cb, cb - ca


def _names(p: Problem) -> set[str]:
    return {w for w, n in zip(p.words, p.name, strict=True) if n and not w.isdecimal()}


def same_problem(a: Problem, b: Problem, max_changed: float = 0.35) -> bool:
    """True if both pose one problem: same quantities, names and situation."""
    if a.numbers != b.numbers:
        return False
    left, right = _unmatched(a, b)
    for x in list(left):
        for y in list(right):
            n = min(left[x], right[y])
            if n and slip(x, y):
                left[x] -= n
                right[y] -= n
    left, right = +left, +right
    # capitals prove a name only where sentence ends are still marked
    known = (_names(a) if a.stops else set()) | (_names(b) if b.stops else set())
    if not (a.stops and a.cased) and not (b.stops and b.cased):
        known = _names(a) | _names(b)
    known -= LANGUAGE_NAMES
    if any(w in known for w in left) and any(w in known for w in right):
        return False
    swapped = min(left.total(), right.total())
    return swapped <= max_changed * min(len(a.words), len(b.words))
