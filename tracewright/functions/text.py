"""Column forms of the scalar text primitives that the operators share.

White space, letters and word ends follow Unicode (as ``str.split``,
``str.isalpha`` and ``\\b`` do in Python), not the ASCII defaults of Java's
regular expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside of a character class: white space as Python has it.
BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{BLANK}]"
NON_WS = f"[^{BLANK}]"
#: A character of a word, and the ends of a word.
WORD = r"[\p{L}\p{N}_]"
BEGIN = rf"(?<!{WORD})"
END = rf"(?!{WORD})"
#: string.punctuation, for use inside a character class.
PUNCTUATION = r"!-/:-@\[-`{-~"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """``text.split()``."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Parts between white space that follows ``.``, ``!`` or ``?``."""
    return F.split(text, f"(?<=[.!?]){WS}+")


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n\n")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def split_lines(text: Column) -> Column:
    """``text.splitlines()``: every kind of line end, no empty last line."""
    parts = F.split(text, "\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]")
    last_empty = F.element_at(parts, -1) == ""
    return F.when(text == "", F.array().cast("array<string>")).when(last_empty, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    """``text.strip()``."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$(?!\n)", "")


def bare(word: Column) -> Column:
    """``word.strip(string.punctuation)``."""
    return F.regexp_replace(word, f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", "")


def is_upper(word: Column) -> Column:
    """``word.isupper()``."""
    return (word == F.upper(word)) & (word != F.lower(word))


def title(text: Column) -> Column:
    """``text.title()``: a capital after every character that is no letter."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    first = lambda r: F.when(F.substring(r, 1, 1) == "ß", "Ss").otherwise(F.upper(F.substring(r, 1, 1)))
    return F.array_join(F.transform(runs, lambda r: F.concat(first(r), F.lower(r.substr(F.lit(2), F.length(r))))), "")


def is_title(word: Column) -> Column:
    """``word.istitle()``."""
    return (word == title(word)) & word.rlike(r"\p{Lu}|\p{Lt}")


def replace_words(text: Column, mapping: dict[str, str]) -> Column:
    """Whole words, in any case, replaced by the map's values."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.coalesce(F.get(F.array(table[F.lower(r)]), F.lit(0)), r)), "")


def pick(key: Column, n: int) -> Column:
    """A choice from 0 to n - 1 that depends on the key alone."""
    return F.pmod(key.cast("long"), F.lit(n)).cast("int")
