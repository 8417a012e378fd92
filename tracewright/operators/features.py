"""Features of a document, and rows for the features that are counts of phrases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import text as t
from tracewright.operators import transforms as tr

#: Punctuation dropped at the ends of phrases.
TRIM = r".?!|;,"


def word_count(text: Column) -> Column:
    return F.size(t.words(text)).cast("long")


def unique_word_count(text: Column) -> Column:
    return F.size(F.array_distinct(t.words(F.lower(text)))).cast("long")


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(t.sentences(text), lambda s: t.strip(s) != "")).cast("long")


def uppercase_word_count(text: Column) -> Column:
    return F.size(F.filter(t.words(text), t.is_upper)).cast("long")


def opens_with_enumeration(text: Column) -> Column:
    return text.rlike(rf"(?iu)\A(?:(?:first|second|third|one|two|three){t.END}|[123]\.(?={t.WORD}))")


def is_alliterative(text: Column, n: int = 4) -> Column:
    """Some n words in a row begin with one letter."""
    first = F.transform(t.words(F.lower(text)), lambda w: F.substring(w, 1, 1))

    def any_run(f: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(f) - (n - 1), F.lit(1)))
        return (F.size(f) >= n) & F.exists(at, lambda i: F.size(F.array_distinct(F.slice(f, i, n))) == 1)

    return t.let(first, any_run)


def is_haiku(text: Column) -> Column:
    """Three lines with 5, 7 and 5 groups of vowels."""
    found = F.filter(t.lines(text), lambda x: t.strip(x) != "")
    return F.transform(found, lambda x: F.regexp_count(F.lower(x), F.lit("[aeiouy]+"))) == F.array(F.lit(5), F.lit(7), F.lit(5))


def scalars(text: Column) -> list[Column]:
    return [
        word_count(text).alias("word_count"),
        unique_word_count(text).alias("unique_word_count"),
        sentence_count(text).alias("sentence_count"),
        tr.paragraph_count(text).alias("paragraph_count"),
        uppercase_word_count(text).alias("uppercase_word_count"),
    ]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scalar features of each document, in one projection."""
    text = F.col(text_col)
    return docs.select(id_col, *scalars(text), F.size(tr.palindromes(text)).cast("long").alias("palindromes"))


def repeats(found: Column, least: int = 2) -> Column:
    """The texts that an array holds ``least`` times or more: ``array<struct<phrase, n>>`` by phrase.

    Counted in the row: the array is sorted and the lengths of its runs are
    read off, so nothing is shuffled.
    """

    def runs(s: Column) -> Column:
        last = lambda i: (i == F.size(s)) | (F.element_at(s, i) != F.element_at(s, F.least(i + 1, F.size(s))))
        ends = F.filter(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))), lambda i: (i <= F.size(s)) & last(i))
        run = lambda e: lambda end, k: F.struct(F.element_at(s, end).alias("phrase"), (end - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("long").alias("n"))
        return F.filter(t.let(ends, lambda e: F.transform(e, run(e))), lambda r: r["n"] >= least)

    return F.when(found.isNotNull(), t.let(F.array_sort(found), runs))


def _phrases(docs: DataFrame, found: Column, id_col: str, least: int = 2) -> DataFrame:
    """Phrases that occur ``least`` times or more in a row's text: ``id, phrase, n``."""
    return docs.select(F.col(id_col), F.explode(repeats(found, least)).alias("r")).select(id_col, "r.phrase", "r.n")


def _trimmed_sentences(text: Column) -> Column:
    return F.filter(F.transform(t.sentences(text), t.strip), lambda s: s != "")


def repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _phrases(docs, _trimmed_sentences(F.col(text_col)), id_col)


def ngrams(found: Column, sizes: tuple[int, ...]) -> Column:
    """Runs of words of the given sizes, joined by blanks."""
    none = F.array().cast("array<string>")

    def runs(w: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
        return F.when(F.size(w) >= n, F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none)

    return t.let(found, lambda w: F.flatten(F.array(*[runs(w, n) for n in sizes])))


def repeated_ngrams(docs: DataFrame, sizes: tuple[int, ...] = (5, 6, 7, 8), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of words (lower case) that a document repeats."""
    return _phrases(docs, ngrams(t.words(F.lower(F.col(text_col))), sizes), id_col)


def trim_phrase(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{TRIM}]+|[{TRIM}]+$", "")


def _ends(parts: Column, spare: int, cut: Callable[[Column, int], Column]) -> Column:
    """3, 4 and 5 words that ``cut`` takes from parts that have more than that plus ``spare``."""

    def of_size(tokens: Column, n: int) -> Column:
        return F.transform(F.filter(tokens, lambda w: F.size(w) > n + spare), lambda w: trim_phrase(F.array_join(cut(w, n), " ")))

    tokens = F.transform(parts, lambda p: F.split(p, " "))
    return t.let(tokens, lambda x: F.flatten(F.array(*[of_size(x, n) for n in (3, 4, 5)])))


def openings(parts: Column) -> Column:
    """First 3, 4 and 5 words of parts that have more words than that."""
    return _ends(parts, 0, lambda w, n: F.slice(w, 1, n))


def closings(parts: Column) -> Column:
    """Last 3, 4 and 5 words of parts with more than 5, 6 and 7."""
    return _ends(parts, 2, lambda w, n: F.slice(w, -n, n))


def sentence_openings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _phrases(docs, openings(F.split(F.col(text_col), r"\. ")), id_col)


def sentence_closings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _phrases(docs, closings(F.split(F.col(text_col), r"\. ")), id_col)


def paragraph_openings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _phrases(docs, openings(t.lines(F.col(text_col))), id_col)


def paragraph_closings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _phrases(docs, closings(t.lines(F.col(text_col))), id_col)


def feature_rows(docs: DataFrame, lexicon: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All features of each document in one row, as maps and scalars: one scan and one projection.

    Only acrostics, which need a ``lexicon``, take a join.
    """
    text = F.col(text_col)
    sentences, paragraphs = F.split(text, r"\. "), t.lines(text)
    phrases = {
        "ngram_repetitions": ngrams(t.words(F.lower(text)), (5, 6, 7, 8)),
        "repeated_sentences": _trimmed_sentences(text),
        "sent_starts_with": openings(sentences),
        "sent_ends_with": closings(sentences),
        "para_starts_with": openings(paragraphs),
        "para_ends_with": closings(paragraphs),
    }
    out = docs.select(
        id_col, *scalars(text), tr.palindromes(text).alias("palindrome"), opens_with_enumeration(text).alias("contains_list_or_enumeration"),
        F.map_from_entries(tr.hypernym_groups(text)).alias("common_noun_hypernyms"),
        *[F.map_from_entries(repeats(found)).alias(name) for name, found in phrases.items()],
    )
    return out if lexicon is None else out.join(hidden_acrostics(docs, lexicon, id_col, text_col), id_col, "left")


def feature_values(rows: DataFrame, id_col: str = "doc_id", first: int = 3) -> DataFrame:
    """``id, feature, value``: features as texts, of lists and maps the first entries; empty ones are left out."""

    def shown(name: str, kind: str) -> Column:
        if kind in ("map", "array"):
            return F.array_join(F.slice(F.map_keys(name) if kind == "map" else F.col(name), 1, first), ", ")
        return F.col(name).cast("string")

    named = [F.struct(F.lit(f.name).alias("feature"), shown(f.name, f.dataType.typeName()).alias("value")) for f in rows.schema.fields if f.name != id_col]
    return rows.select(id_col, F.explode(F.array(*named)).alias("f")).where("f.value <> ''").select(id_col, "f.feature", "f.value")


def initials(text: Column) -> Column:
    """First letters of the parts between full stops."""
    parts = F.filter(F.transform(F.split(text, r"\."), t.strip), lambda s: s != "")
    return F.array_join(F.transform(parts, lambda s: F.lower(F.substring(s, 1, 1))), "")


def hidden_acrostics(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word of 6, else 5, else 4 letters among the initials that ``lexicon`` (``word``) has; the first of its length."""
    letters = docs.select(id_col, initials(F.col(text_col)).alias("s"))
    none = F.array().cast("array<struct<size:int,at:int,word:string>>")

    def of_size(n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length("s") - (n - 1), F.lit(1)))
        spot = lambda i: F.struct(F.lit(-n).alias("size"), i.alias("at"), F.col("s").substr(i, F.lit(n)).alias("word"))
        return F.when(F.length("s") >= n, F.transform(at, spot)).otherwise(none)

    spots = F.flatten(F.array(of_size(6), of_size(5), of_size(4)))
    found = letters.select(id_col, F.explode(spots).alias("c")).select(id_col, "c.*").join(lexicon.select("word").distinct(), "word", "left_semi")
    return found.groupBy(id_col).agg(F.min(F.struct("size", "at", "word"))["word"].alias("hidden_acrostic"))


def common_hypernyms(nouns: DataFrame, ancestors: DataFrame, stop: list[str], id_col: str = "doc_id") -> DataFrame:
    """Lowest common ancestors of pairs of a document's nouns, with the nouns under each.

    ``nouns``: ``id, noun``; ``ancestors``: ``noun, ancestor, depth`` (a
    lexicon).  Pairs are made within a document only, through shared
    ancestors.  Result: ``id, hypernym, nouns``.
    """
    placed = nouns.select(id_col, "noun").distinct().join(ancestors, "noun")
    a, b = placed.alias("a"), placed.alias("b")
    pairs = a.join(
        b,
        (F.col(f"a.{id_col}") == F.col(f"b.{id_col}")) & (F.col("a.ancestor") == F.col("b.ancestor")) & (F.col("a.noun") < F.col("b.noun")),
    ).select(F.col(f"a.{id_col}").alias(id_col), F.col("a.noun").alias("x"), F.col("b.noun").alias("y"), F.col("a.ancestor").alias("ancestor"), F.col("a.depth").alias("depth"))
    lowest = pairs.groupBy(id_col, "x", "y").agg(F.max(F.struct("depth", "ancestor"))["ancestor"].alias("hypernym")).where(~F.col("hypernym").isin(stop))
    return lowest.groupBy(id_col, "hypernym").agg(F.array_sort(F.array_union(F.collect_set("x"), F.collect_set("y"))).alias("nouns"))


def rhymes_abab(lines: DataFrame, pronunciations: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of four lines whose last words rhyme in turn.

    ``lines``: ``id, line_no (0..3), last_word``; ``pronunciations``: ``word,
    phonemes array<string>``; the last three phonemes are compared.
    """
    sounds = lines.join(pronunciations, F.col("last_word") == F.col("word")).select(id_col, "line_no", F.array_join(F.slice("phonemes", F.greatest(F.size("phonemes") - 2, F.lit(1)), 3), " ").alias("sound"))
    four = sounds.groupBy(id_col).pivot("line_no", [0, 1, 2, 3]).agg(F.first("sound"))
    return four.select(id_col, F.coalesce((F.col("0") == F.col("2")) & (F.col("1") == F.col("3")) & (F.col("0") != F.col("1")), F.lit(False)).alias("rhymes"))
