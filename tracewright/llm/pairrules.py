"""Rules for one prompt and its response: empty, copied, refused, cut, in another language."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

from tracewright.llm.endings import ending, parts
from tracewright.llm.fold import fold, strip_markup
from tracewright.llm.languages import LanguageModel, plain
from tracewright.llm.sameproblem import problem_text, slip

# Stand-ins for no value, in lower case and without marks.
STAND_INS = frozenset(
    "null|none|nil|na|n/a|nan|undefined|tbd|tba|todo|empty|blank|missing|no answer|no response|no output|nothing|void|"
    "k. a.|keine|keine antwort|leer|aucune réponse|néant|vide|ninguna respuesta|sin respuesta|vacío|nada".split("|")
)

_BARE = re.compile(r"<[^<>]*>|&(?:nbsp|#160|zwnj|zwj|#8203);|\\(?:boxed|text|quad|;|,|!)?\s*\{\s*\}|\\\[|\\\]|[\s*_`#~$\\|]+")
_FINAL = re.compile(r"\\boxed\s*\{\s*[^{}\s]|\*\*[^*\n]{1,40}:\*\*\s*\S|:\s*[-−]?\d[\d.,]*\s*\S*\s*$", re.I)

# Ways to decline, by language.
_DECLINES = re.compile(
    r"\b(?:"
    r"i (?:can ?not|can'?t|could not|couldn'?t|won'?t|will not|am not able to|am unable to|'m unable to|must decline|have to decline|need to decline|have to pass|must pass|must refuse|refuse to|decline to|would rather not|'d rather not|prefer not to|'m not permitted|am not permitted|'m not allowed|am not allowed|'m not able|do not feel comfortable|don'?t feel comfortable|am not comfortable|'m not comfortable)"
    r"|(?:i am|i'm) (?:not (?:willing|prepared|going|inclined|in a position|authori[sz]ed|able)|unwilling|unable)|not something (?:that )?i\b|beyond what i (?:can|may|am)"
    r"|i (?:do not|don't|did not) (?:want|wish|intend|plan) to (?:answer|help|solve|do|respond|discuss|give)|(?:can ?not|can't|won't|will not) be (?:answered|solved|done) by me|no answer (?:from me|will be given)"
    r"|i'm (?:unable to|not able|not permitted|not allowed|not comfortable)"
    r"|my (?:guidelines|rules|policy|policies|instructions) (?:keep|prevent|forbid|prohibit|do not allow|don'?t allow|do not permit|stop)"
    r"|(?:against|outside) my (?:guidelines|rules|policy|policies)"
    r"|ich (?:kann|könnte|darf|möchte|will|werde)\b[^.!?]{0,40}\b(?:nicht|nichts|keine?n?|ablehnen)\b|(?:kann|darf|möchte|will|werde) ich\b[^.!?]{0,60}\b(?:nicht|nichts|keine?n?)\b|ich bin nicht (?:in der lage|befugt|berechtigt)|ich lehne\b|ich muss[^.!?]{0,40}ablehnen|ich sehe mich außerstande|ich weigere mich|ich bin nicht (?:bereit|gewillt)|(?:beantworte|löse|bearbeite|sage) ich (?:dazu |hierzu )?nichts?\b|mir (?:ist|wurde) (?:es )?nicht (?:gestattet|erlaubt|möglich)"
    r"|(?:meine )?(?:richtlinien|regeln|vorgaben) (?:verbieten|erlauben|untersagen|verhindern|lassen)"
    r"|je n'ai pas (?:le droit|l'autorisation|la possibilité)|il m'est (?:impossible|interdit)|je m'abstiens|je me refuse|je (?:ne (?:peux|puis|suis|veux|souhaite|pourrai|saurais|vais)|refuse|préfère ne|préférerais ne|dois (?:refuser|décliner)|suis (?:incapable|dans l'impossibilité|contraint)|décline)"
    r"|mes (?:règles|consignes|directives|principes) (?:m'interdisent|ne me permettent|m'empêchent)"
    r"|no (?:(?:te|le|os|les) )?(?:puedo|podré|me es posible|me está permitido|soy capaz|estoy autorizad[oa]|estoy en condiciones|deseo|quiero|voy a)|me niego|me abstengo|no tengo (?:permiso|autorización)|no estoy dispuest[oa]|me (?:es|resulta) imposible|debo (?:rechazar|declinar|negarme)|prefiero no|mis (?:normas|directrices|reglas|pautas) (?:me )?(?:prohíben|impiden|no)"
    r")",
    re.I,
)
_WEIRD_QUOTES = str.maketrans({"’": "'", "ʼ": "'", "‘": "'", "´": "'"})

# Names of the four languages, as an answer is asked for in them.
_ASKED = {
    "en": "english englisch anglais inglés ingles",
    "de": "german deutsch allemand alemán aleman",
    "fr": "french französisch français francais francés frances",
    "es": "spanish spanisch espagnol español espanol",
}
_ASKED_BY_NAME = {n: code for code, names in _ASKED.items() for n in names.split()}
_ASKED_RE = re.compile(r"\b(?:in|auf|en|into|into the|use|using|only)\s+(" + "|".join(_ASKED_BY_NAME) + r")\b|\b(" + "|".join(_ASKED_BY_NAME) + r")\s+only\b", re.I)
_WORD = re.compile(r"[^\W\d_]+|\d+")
_DIGITS = re.compile(r"\d+")


class Verdict(NamedTuple):
    """``defect`` that the pair alone shows, and how the response ends.

    ``empty``, ``copy`` and ``refusal`` are final.  A response in state cut is
    truncated; one in state open waits for the corpus, and only where it is
    found complete does ``other_language`` hold.
    """

    defect: str | None
    state: str
    tail: str | None
    chars: int
    octets: int
    punctuated: bool = False


def asked_language(prompt: str) -> str | None:
    """Language that the prompt asks the answer to be in, if it names one."""
    found = _ASKED_RE.findall(fold(prompt))
    return _ASKED_BY_NAME[(found[-1][0] or found[-1][1]).casefold()] if found else None


def is_blank(answer: str | None) -> bool:
    """Nothing readable: missing, invisible, bare markup or a stand-in for no value."""
    if answer is None:
        return True
    core = _BARE.sub(" ", fold(answer)).strip()
    bare = core.strip(".…-–—?!:;,'\"()[]{}<>/=+ ").casefold()
    return not bare or bare in STAND_INS or core.casefold() in STAND_INS


def is_refusal(answer: str, prompt: str = "") -> bool:
    """The answer declines, gives no result and no quantity that the prompt does not hold.

    ``answer`` and ``prompt`` are folded.  The length does not matter: remarks
    of doubt on the way to a result stand among new quantities or before it.
    """
    text = answer.translate(_WEIRD_QUOTES)
    if "\\boxed{" in text or _DECLINES.search(text) is None or _FINAL.search(text) is not None:
        return False
    return set(_DIGITS.findall(text)) <= set(_DIGITS.findall(prompt))


def is_copy(question: list[str], answer: list[str], whole: bool) -> bool:
    """The answer's words are the question's; ``whole`` if it does not stop halfway."""
    # what is missing and what is extra may make up no more than this
    if len(question) < 4 or not 0.8 * len(question) <= len(answer) <= 1.3 * len(question) + 6:
        return False
    q, a = Counter(question), Counter(answer)
    missing, extra = q - a, a - q
    for x in list(missing):
        for y in list(extra):
            n = min(missing[x], extra[y])
            if n and slip(x, y):
                missing[x] -= n
                extra[y] -= n
    missing, extra = +missing, +extra
    if any(w.isdecimal() for w in extra) or any(w.isdecimal() for w in missing):
        return False
    if missing.total() > 0.2 * len(question) or extra.total() > 0.3 * len(question) + 6:
        return False
    return whole or answer[-1] == question[-1] or slip(answer[-1], question[-1])


class _Prompt(NamedTuple):
    folded: str
    words: list[str]
    expected: str | None
    runs: frozenset[tuple[str, ...]]


def prompt_reader(model: LanguageModel | None):
    """Reads a prompt: its words, the expected language (none without a model) and its runs of four words."""

    @lru_cache(maxsize=2048)
    def read(prompt: str) -> _Prompt:
        core = problem_text(prompt)
        words = [w.casefold() for w in _WORD.findall(core)]
        expected = (asked_language(prompt) or model.language(core)) if model else None
        return _Prompt(fold(prompt), words, expected, frozenset(zip(words, words[1:], words[2:], words[3:], strict=False)))

    return read


def _own_words(words: list[str], runs: frozenset[tuple[str, ...]]) -> str:
    """The words of an answer without passages restated from the prompt."""
    quoted = set()
    for i in range(len(words) - 3):
        if tuple(words[i : i + 4]) in runs:
            quoted.update(range(i, i + 4))
    return " ".join(w for i, w in enumerate(words) if i not in quoted)


_PLAIN = plain()


def judge(prompt: str | None, response: str | None, model: LanguageModel | None = _PLAIN, read=None) -> Verdict:
    """Defect of one pair, as far as it can be told from the pair alone; without ``model`` languages are not judged."""
    if response is None:
        return Verdict("empty", "blank", None, 0, 0)
    folded = fold(response)
    end = ending(response, folded)

    def result(defect: str | None) -> Verdict:
        return Verdict(defect, *end)

    part = parts(folded)
    if part.unfinished:
        return result("empty" if end.state in ("closed", "blank") else None)
    if is_blank(part.answer):
        # a tag that breaks off is a cut, a lone mark is a stand-in
        return result(None if end.state == "cut" and "<" in part.answer else "empty")
    asked = (read or prompt_reader(model))(prompt or "")
    said = [w.casefold() for w in _WORD.findall(problem_text(part.answer))]
    if is_copy(asked.words, said, end.state == "closed"):
        return result("copy")
    # a text that breaks off may only have come as far as "I cannot"
    if end.state == "closed" and is_refusal(part.answer, asked.folded):
        return result("refusal")
    if model and asked.expected and end.state != "cut":
        got = model.language(_own_words(said, asked.runs))
        if got is None or got == asked.expected:
            got = model.language(part.reasoning) if part.reasoning else None
        if got and got != asked.expected:
            return result("other_language")
    return result(None)
