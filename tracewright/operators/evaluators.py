"""Predicates that check whether a text complies with an instruction.

Each takes the text and the reference text and gives 1 or 0 as a long; a null
text gives null.  Where the rule compares with the reference text, the same
expressions as in the transforms are used on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import text as t
from tracewright.functions.external import detect_language, html_errors
from tracewright.operators import transforms as tr

Evaluator = Callable[[Column, Column], Column]


def _bit(condition: Column) -> Column:
    return condition.cast("int").cast("long")


def _subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def _no_word(text: Column, word: str) -> Column:
    return ~text.rlike(f"(?iu){t.BEGIN}{word}{t.END}")


def partial_solution(text: Column, gt: Column) -> Column:
    return _bit(text.contains("<partial_solution>") & text.contains("</partial_solution>"))


def change_of_thought(text: Column, gt: Column) -> Column:
    return _bit(text.contains("<change_of_thought>") == gt.contains("<change_of_thought>"))


def avoid_the(text: Column, gt: Column) -> Column:
    return _bit(_no_word(text, "the"))


def include_word(text: Column, gt: Column) -> Column:
    a, b = tr.top_word(text), tr.top_word(gt)
    return _bit((a["word"] == b["word"]) & (a["freq"] == b["freq"]))


def replace_and_ampersand(text: Column, gt: Column) -> Column:
    return _bit(_no_word(text, "and"))


def one_word_per_line(text: Column, gt: Column) -> Column:
    return _bit(t.strip(text) == tr.one_word_per_line(text))


def use_multiple_spaces(text: Column, gt: Column) -> Column:
    """All runs of spaces inside the text have one length, of 2 to 4."""
    runs = F.regexp_extract_all(text, F.lit(rf"{t.NON_WS}( +)(?={t.NON_WS})"), 1)
    sizes = F.array_distinct(F.transform(runs, F.length))
    return _bit(t.let(sizes, lambda s: (F.size(s) == 0) | ((F.size(s) == 1) & F.coalesce(F.get(s, F.lit(0)).between(2, 4), F.lit(False)))))


def upper_case(text: Column, gt: Column) -> Column:
    return _bit(text == F.upper(text))


def lower_case(text: Column, gt: Column) -> Column:
    return _bit(text == F.lower(text))


def lower_case_compat(text: Column, gt: Column) -> Column:
    """Older behaviour: compares with capitals."""
    return upper_case(text, gt)


def title_case(text: Column, gt: Column) -> Column:
    return _bit(text == t.title(text))


def upper_case_backward(text: Column, gt: Column) -> Column:
    """The first three words in capitals are among the reference's, and none stands in small letters too."""
    a, b = F.slice(tr.upper_words(text), 1, 3), F.slice(tr.upper_words(gt), 1, 3)
    return _bit(_subset(a, b) & F.forall(a, lambda w: F.instr(text, F.lower(w)) == 0))


def title_case_backward(text: Column, gt: Column) -> Column:
    return _bit(_subset(tr.title_words(text), tr.title_words(gt)))


def sentences_per_line(text: Column, gt: Column) -> Column:
    return _bit(F.forall(t.split_lines(text), lambda x: (t.strip(x) == "") | t.strip(x).rlike(r"[.!?]\z")))


def commas_to_semicolons(text: Column, gt: Column) -> Column:
    return _bit(~text.contains(", "))


def full_stops_to_exclamation_marks(text: Column, gt: Column) -> Column:
    return _bit(~text.contains("."))


def add_line_numbers(text: Column, gt: Column) -> Column:
    return _bit(F.forall(t.split_lines(text), lambda x: x.rlike(rf"^\p{{Nd}}+[:.)\-]{t.WS}")))


def contains_list_or_enumeration(text: Column, gt: Column) -> Column:
    return _bit(tr.is_enumeration(text) == tr.is_enumeration(gt))


def json_of_paragraphs(text: Column, gt: Column) -> Column:
    """An object whose ``paragraphs`` is a list of strings."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), "$.paragraphs", "variant"))
    return _bit(F.coalesce(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))) + F.when(text.isNull(), None).otherwise(F.lit(0)).cast("long")


def bracket_sentences(text: Column, gt: Column) -> Column:
    return _bit(text.rlike(rf"\A\[[^\[\]]+\](?:{t.WS}*\[[^\[\]]+\])*\z"))


def indent_paragraphs(text: Column, gt: Column) -> Column:
    return _bit(F.forall(t.split_lines(text), lambda x: (t.strip(x) == "") | x.startswith("\t")))


def highlight_logical_words(text: Column, gt: Column) -> Column:
    return _bit(~text.rlike(rf"(?iu)(?<!\*){t.BEGIN}(?:{'|'.join(tr.CONNECTORS)}){t.END}(?!\*)"))


def insert_sentence_divider(text: Column, gt: Column) -> Column:
    """Two or more parts by a bar, each ending in ``.``, ``!`` or ``?``."""
    parts = F.transform(F.split(text, r"\|"), t.strip)
    return _bit((F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(r"[.!?]\z")))


def render_as_html(text: Column, gt: Column) -> Column:
    return _bit(html_errors(text) == 0)


def palindromes(text: Column, gt: Column) -> Column:
    return _bit(_subset(tr.palindromes(text), tr.palindromes(gt)))


def hypernyms(text: Column, gt: Column) -> Column:
    """The things that the picked kind of the reference names are named in the text; true if the reference has no such kind."""
    wanted = F.coalesce(tr.picked_hypernym(gt)["nouns"], F.array().cast("array<string>"))
    return F.when(text.isNotNull(), _bit(_subset(wanted, F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))))


def paragraph_count(text: Column, gt: Column) -> Column:
    return _bit(tr.paragraph_count(text) == tr.paragraph_count(gt))


def translate(text: Column, gt: Column) -> Column:
    """Both texts are in one language, by the built-in detector."""
    return F.when(text.isNotNull(), _bit(detect_language(text).eqNullSafe(detect_language(gt))))


def replace_words_with_emojis(text: Column, gt: Column) -> Column:
    return _bit(_subset(tr.emoji_words(text), tr.emoji_words(gt)))


#: Evaluators by the name of the function they belong to.
EVALUATORS: dict[str, Evaluator] = {
    "partial_solution": partial_solution,
    "change_of_thought": change_of_thought,
    "avoid_the_forward": avoid_the,
    "include_word_forward": include_word,
    "replace_and_ampersand_forward": replace_and_ampersand,
    "one_word_per_line_forward": one_word_per_line,
    "use_multiple_spaces_forward": use_multiple_spaces,
    "upper_case_forward": upper_case,
    "upper_case_backward": upper_case_backward,
    "lower_case_forward": lower_case,
    "title_case_forward": title_case,
    "title_case_backward": title_case_backward,
    "sentences_per_line_forward": sentences_per_line,
    "commas_to_semicolons_forward": commas_to_semicolons,
    "full_stops_to_exclamation_marks_forward": full_stops_to_exclamation_marks,
    "add_line_numbers_forward": add_line_numbers,
    "contains_list_or_enumeration_forward": contains_list_or_enumeration,
    "json_of_paragraphs_forward": json_of_paragraphs,
    "bracket_sentences_forward": bracket_sentences,
    "indent_paragraphs_forward": indent_paragraphs,
    "highlight_logical_words_forward": highlight_logical_words,
    "insert_sentence_divider_forward": insert_sentence_divider,
    "render_as_html_forward": render_as_html,
    "palindromes_backward": palindromes,
    "hypernyms_backward": hypernyms,
    "paragraph_count_backward": paragraph_count,
    "translate_forward": translate,
    "replace_words_with_emojis": replace_words_with_emojis,
}

#: Evaluators that run in Python.
EXTERNAL = frozenset({"render_as_html_forward"})


def dispatch(name: Column, text: Column, gt: Column, functions: list[str] | None = None) -> Column:
    """The score of the evaluator that ``name`` names; null where there is none.

    One row is judged by one evaluator only: the branches of a ``when`` chain
    are evaluated lazily.  Python is called for all rows of a batch, so there
    the texts of other functions are null.
    """
    out = F.lit(None).cast("long")
    for key in functions or EVALUATORS:
        own = F.when(name == key, text) if key in EXTERNAL else text
        out = F.when(name == key, EVALUATORS[key](own, gt)).otherwise(out)
    return out


def scores(names: Column, text: Column, gt: Column) -> Column:
    """``array<struct<function_name, score>>`` of all evaluators in the array ``names``, in one projection.

    Evaluators that are not named are not evaluated; a name without evaluator
    has a null score.
    """
    wanted = lambda n: F.array_contains(names, n)
    entry = lambda n, s: F.struct(F.lit(n).alias("function_name"), s.cast("long").alias("score"))
    known = [F.when(wanted(n), entry(n, EVALUATORS[n](F.when(wanted(n), text) if n in EXTERNAL else text, gt))) for n in sorted(EVALUATORS)]
    other = F.transform(F.array_except(names, F.array(*[F.lit(n) for n in EVALUATORS])), lambda n: F.struct(n.alias("function_name"), F.lit(None).cast("long").alias("score")))
    return F.concat(F.filter(F.array(*known), lambda x: x.isNotNull()), other)


def forward_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each forward transform applied and judged: mean score and count per function."""
    names = [n for n in tr.FORWARD if n in EVALUATORS]
    text = F.col(text_col)

    def score(name: str) -> Column:
        if name in EXTERNAL:  # Python cannot be called in a lambda
            return EVALUATORS[name](tr.FORWARD[name][0](text), text)
        # bound, since an evaluator may use its text several times
        return t.let(tr.FORWARD[name][0](text), lambda x: EVALUATORS[name](x, text))

    cases = [F.struct(F.lit(n).alias("function_name"), score(n).alias("score")) for n in names]
    return (
        docs.where(text.isNotNull())
        .select(F.explode(F.array(*cases)).alias("c"))
        .groupBy(F.col("c.function_name").alias("function_name"))
        .agg(F.round(F.avg("c.score"), 9).alias("accuracy"), F.count("*").alias("examples"))
    )
