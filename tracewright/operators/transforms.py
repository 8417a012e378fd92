"""Text transforms: forward operators rewrite the text, backward ones describe it.

Each is a function from a text column to a struct ``description, new_text``;
both are null where the transform does not apply.  All are expressions of
built-in functions, so a query that uses many of them is one projection over
one scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions import text as t

# Connector words to highlight.
CONNECTORS = "hmm wait now thus therefore so consequently alternatively then okay alright again but yes".split()
# Words and the emoji each becomes.
EMOJIS = {
    "error": "❌", "warning": "⚠️", "analysis": "🔍", "result": "✅", "success": "🎉", "failure": "💔", "logic": "🤔",
    "calculate": "🧮", "problem": "❓", "solution": "💡", "reasoning": "🧠", "trace": "📝", "thought": "💭", "data": "📊",
    "compute": "💻", "model": "🤖", "optimization": "⚙️", "test": "🧪", "experiment": "🔬", "input": "📥", "output": "📤",
    "unknown": "❓", "uncertain": "🤷", "prompt": "💬", "instruct": "📝",
}
# How an enumerated line begins ("siz" stands for six).
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth one two three four five siz seven eight nine ten".split()
# The page around rendered paragraphs.
PAGE_HEAD = "<!DOCTYPE html>\n<html>\n<head>\n  <meta charset='UTF-8'>\n  <title>Reasoning chain</title>\n</head>\n<body>\n"
PAGE_FOOT = "\n</body>\n</html>"

Transform = Callable[[Column], Column]


def _result(description: Column | str, new_text: Column) -> Column:
    note = F.lit(description) if isinstance(description, str) else description
    return F.struct(note.alias("description"), new_text.alias("new_text"))


def _when_any(found: Column, description: Column, text: Column) -> Column:
    """Description and unchanged text where something was found, else two nulls."""
    return _result(F.when(found, description), F.when(found, text))


# Forward transforms of the text alone.


def identity(text: Column) -> Column:
    return text


def upper_case(text: Column) -> Column:
    return F.upper(text)


def lower_case(text: Column) -> Column:
    return F.lower(text)


def title_case(text: Column) -> Column:
    return t.title(text)


def avoid_sentence_start(text: Column, word: str) -> Column:
    """Without the word, and the character after it, where it opens a sentence; what follows gets a capital."""
    marked = F.regexp_replace(text, rf"(?iu)(^|[.?!:][ \n]+){word}{t.END}[^\n] ?([^\n])", "$1\x01$2")
    tail = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))
    return F.array_join(F.transform(F.split(marked, "\x01"), lambda p, i: F.when(i == 0, p).otherwise(tail(p))), "")


def avoid_word(text: Column, word: str) -> Column:
    return F.regexp_replace(avoid_sentence_start(text, word), f"(?iu){t.BEGIN}{word}{t.END} ?", "")


def avoid_the(text: Column) -> Column:
    return avoid_word(text, "the")


def replace_word(text: Column, old: str, new: str) -> Column:
    """The word as written and with a first capital; other spellings stay."""
    for a, b in ((old, new), (old.capitalize(), new.capitalize())):
        text = F.regexp_replace(text, f"{t.BEGIN}{a}{t.END}", b)
    return text


def replace_and_ampersand(text: Column) -> Column:
    return replace_word(text, "and", "&")


def one_word_per_line(text: Column) -> Column:
    return F.array_join(t.words(text), "\n")


def use_multiple_spaces(text: Column, spaces: int | Column = 3) -> Column:
    """Runs of spaces become ``spaces`` (2 to 4) spaces."""
    n = F.lit(spaces) if isinstance(spaces, int) else spaces
    return F.regexp_replace(text, F.lit(" +"), F.repeat(F.lit(" "), n))


def sentences_per_line(text: Column) -> Column:
    return F.array_join(t.sentences(text), "\n")


def commas_to_semicolons(text: Column) -> Column:
    return F.translate(text, ",", ";")


def full_stops_to_exclamation_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"\.([ \n])", "!$1")


def add_line_numbers(text: Column) -> Column:
    return F.array_join(F.transform(t.split_lines(text), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")


def json_of_paragraphs(text: Column) -> Column:
    return F.to_json(F.struct(t.paragraphs(text).alias("paragraphs")))


def bracket_sentences(text: Column) -> Column:
    return F.array_join(F.transform(t.sentences(text), lambda s: F.concat(F.lit("["), s, F.lit("]"))), " ")


def indent_paragraphs(text: Column) -> Column:
    return F.array_join(F.transform(t.paragraphs(text), lambda p: F.concat(F.lit("\t"), p)), "\n\n")


def highlight_logical_words(text: Column) -> Column:
    return F.regexp_replace(text, f"(?iu){t.BEGIN}({'|'.join(CONNECTORS)}){t.END}", "*$1*")


def insert_sentence_divider(text: Column, divider: str = " | ") -> Column:
    return F.array_join(t.sentences(text), divider)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_paragraphs(text: Column) -> Column:
    body = lambda p: F.replace(escape_html(p), F.lit("\n"), F.lit("<br>"))
    return F.array_join(F.transform(t.paragraphs(text), lambda p: F.concat(F.lit("<p>"), body(p), F.lit("</p>"))), "")


def render_as_html(text: Column) -> Column:
    return F.concat(F.lit(PAGE_HEAD), html_paragraphs(text), F.lit(PAGE_FOOT))


def replace_words_with_emojis(text: Column) -> Column:
    return t.replace_words(text, EMOJIS)


def emoji_words(text: Column) -> Column:
    """The words, as written, that :func:`replace_words_with_emojis` replaces; each once."""
    known = F.array(*[F.lit(w) for w in EMOJIS])
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: F.array_contains(known, F.lower(w))))


#: Forward transforms by name, with the instruction that asks for them.
FORWARD: dict[str, tuple[Transform, str]] = {
    "identity": (identity, "Reason as you like."),
    "upper_case_forward": (upper_case, "Use capital letters only."),
    "lower_case_forward": (lower_case, "Use small letters only."),
    "title_case_forward": (title_case, "Begin every word with a capital."),
    "avoid_the_forward": (avoid_the, 'Do without the word "the/The".'),
    "replace_and_ampersand_forward": (replace_and_ampersand, 'Write "&" for "and/And".'),
    "one_word_per_line_forward": (one_word_per_line, "Give each word a line of its own."),
    "use_multiple_spaces_forward": (use_multiple_spaces, "Put 3 spaces between words."),
    "sentences_per_line_forward": (sentences_per_line, "Begin a new line for each sentence."),
    "commas_to_semicolons_forward": (commas_to_semicolons, "Write semicolons for commas."),
    "full_stops_to_exclamation_marks_forward": (full_stops_to_exclamation_marks, "End sentences with exclamation marks."),
    "add_line_numbers_forward": (add_line_numbers, "Number the lines from 1."),
    "json_of_paragraphs_forward": (json_of_paragraphs, 'Write JSON with a list "paragraphs".'),
    "bracket_sentences_forward": (bracket_sentences, "Put each sentence into square brackets."),
    "indent_paragraphs_forward": (indent_paragraphs, "Begin each paragraph with a tab."),
    "highlight_logical_words_forward": (highlight_logical_words, "Put asterisks around logical connectors."),
    "insert_sentence_divider_forward": (insert_sentence_divider, 'Part the sentences with " | ".'),
    "render_as_html_forward": (render_as_html, "Write an HTML page with one <p> per paragraph."),
    "replace_words_with_emojis": (replace_words_with_emojis, "Write emojis for the words that have one."),
}


def apply_forward(name: str, text: Column) -> Column:
    """Struct of description and new text of a forward transform."""
    function, description = FORWARD[name]
    return _result(description, function(text))


# Backward operators: what the text is like.


def top_word(text: Column) -> Column:
    """Most frequent word in lower case with its count, ties by first place; struct ``word, freq``."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    # sorted by word and place, equal words are runs; the first of a run is the word's first place
    placed = F.array_sort(F.transform(found, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))

    def best(s: Column) -> Column:
        word = lambda i: F.element_at(s, i)["word"]
        begins = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (word(i) != word(F.greatest(i - 1, F.lit(1)))))
        run = lambda b, end: F.struct((end - b).alias("freq"), (-F.element_at(s, b)["at"]).alias("p"), word(b).alias("word"))
        runs = t.let(begins, lambda x: F.transform(x, lambda b, k: run(b, F.coalesce(F.get(x, k + 1), F.size(s) + 1))))
        top = F.array_max(runs)
        return F.when(F.size(s) > 0, F.struct(top["word"].alias("word"), top["freq"].cast("long").alias("freq")))

    return t.let(placed, best)


def include_word(text: Column) -> Column:
    best = top_word(text)
    note = F.concat(F.lit('Include the word "'), best["word"], F.lit('", which appears '), best["freq"].cast("string"), F.lit(" times."))
    return _when_any(best.isNotNull(), note, text)


def _first_three(found: Column) -> Column:
    return F.array_join(F.slice(found, 1, 3), ", ")


def upper_words(text: Column) -> Column:
    """Words in capitals, without punctuation at their ends."""
    return F.filter(F.transform(t.words(text), t.bare), t.is_upper)


def title_words(text: Column) -> Column:
    return F.filter(F.transform(t.words(text), t.bare), t.is_title)


def palindromes(text: Column) -> Column:
    """Words of more than three characters that read both ways, in any case."""
    return F.filter(F.transform(t.words(text), t.bare), lambda w: (F.length(w) > 3) & (F.lower(w) == F.reverse(F.lower(w))))


def upper_case_backward(text: Column) -> Column:
    found = upper_words(text)
    return _when_any(F.size(found) > 0, F.concat(F.lit("Write in capitals: "), _first_three(found)), text)


def title_case_backward(text: Column) -> Column:
    found = title_words(text)
    return _when_any(F.size(found) > 0, F.concat(F.lit("Begin with a capital: "), _first_three(found)), text)


def palindromes_backward(text: Column) -> Column:
    found = palindromes(text)
    return _when_any(F.size(found) > 0, F.concat(F.lit("Use the palindromes: "), _first_three(found)), text)


def is_enumeration(text: Column) -> Column:
    """Every line that is not blank opens with an ordinal, a number word or a number; true for blank text."""
    opening = rf"^(?:(?:{'|'.join(ORDINALS)}){t.END}|\p{{Nd}}+[.):](?={t.WS}|$))"
    return F.forall(t.split_lines(text), lambda x: (t.strip(x) == "") | F.lower(t.strip(x)).rlike(opening))


def contains_list_or_enumeration(text: Column) -> Column:
    return _when_any(is_enumeration(text), F.lit("Number the steps."), text)


def paragraph_count(text: Column) -> Column:
    """Lines that are not blank."""
    return F.size(F.filter(t.lines(text), lambda x: t.strip(x) != "")).cast("long")


def paragraph_count_backward(text: Column) -> Column:
    n = paragraph_count(text)
    return _when_any(n > 0, F.concat(F.lit("Write "), n.cast("string"), F.lit(" paragraphs.")), text)


# A small lexicon of things by kind, as the words stand in texts.  A larger one, with any
# depth, is a table for :func:`tracewright.operators.features.common_hypernyms`.
KINDS: dict[str, str] = {
    "container": "basket baskets box boxes crate crates jar jars tray trays barrel barrels sack sacks bottle bottles bowl bowls kettle kettles mug mugs",
    "fabric": "ribbon ribbons blanket blankets sheet sheets cotton silk wool linen felt",
    "food": "apple apples lemon lemons cheese cake cakes barley honey salt plum plums fish",
    "material": "copper iron steel brass clay glass tin oak pine cork wood leather paper",
    "place": "field fields road roads town towns depot depots workshop workshops shelf shelves",
    "vehicle": "wagon wagons bicycle bicycles ferry train trains boat boats",
}


def hypernym_groups(text: Column) -> Column:
    """Kinds of which a text names two things or more: ``array<struct<hypernym, nouns>>``, both in order."""

    def groups(found: Column) -> Column:
        of = lambda kind: F.struct(F.lit(kind).alias("hypernym"), F.filter(found, lambda w: w.isin(KINDS[kind].split())).alias("nouns"))
        return F.filter(F.array(*[of(k) for k in sorted(KINDS)]), lambda g: F.size(g["nouns"]) >= 2)

    return t.let(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))), groups)


def picked_hypernym(text: Column) -> Column:
    """One of the groups, chosen by hash; null without any."""
    keyed = F.transform(hypernym_groups(text), lambda g: F.struct(F.md5(F.concat_ws("|", g["hypernym"], F.get(g["nouns"], F.lit(0)))).alias("k"), g["hypernym"].alias("hypernym"), g["nouns"].alias("nouns")))
    return F.array_min(keyed)


def hypernyms_backward(text: Column) -> Column:
    return t.let(
        picked_hypernym(text),
        lambda g: _when_any(g.isNotNull(), F.concat(F.lit("Name kinds of "), g["hypernym"], F.lit(": "), _first_three(g["nouns"])), text),
    )


#: Backward operators by name.
BACKWARD: dict[str, Transform] = {
    "include_word_forward": include_word,
    "upper_case_backward": upper_case_backward,
    "title_case_backward": title_case_backward,
    "contains_list_or_enumeration_forward": contains_list_or_enumeration,
    "palindromes_backward": palindromes_backward,
    "hypernyms_backward": hypernyms_backward,
    "paragraph_count_backward": paragraph_count_backward,
}


def strip_left_stopwords(text: Column, stop: list[str], keep: list[str]) -> Column:
    """Without leading words of ``stop``, up to the first other word or one of ``keep``."""
    found = t.words(text)
    stops, keeps = F.array(*[F.lit(w) for w in stop]), F.array(*[F.lit(w) for w in keep])
    matters = F.transform(found, lambda w: ~F.array_contains(stops, F.lower(w)) | F.array_contains(keeps, F.regexp_replace(F.lower(w), r"^\.+|\.+$", "")))
    at = F.array_position(matters, True)
    return F.when(at > 0, F.array_join(F.slice(found, at.cast("int"), F.size(found)), " ")).otherwise("")
