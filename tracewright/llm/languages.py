"""Which language a text is in: a word model fitted on labelled texts.

``fit`` takes a bounded sample of a labelled table (``ROWS`` texts, chosen by a
hash of the text so that every language keeps its share), counts in how many
texts of each language a word occurs, and keeps the ``WORDS`` most frequent
words, so the model has one size whatever the table's.  Wrong labels only blur
it: a word's weight is clipped.  Without labelled texts ``plain`` makes the
same kind of model from short lists of frequent words.

A text is in the language with the largest sum of weights, if that leads
clearly.  A text of many words of which hardly any is known in any language is
in an unknown one (only a fitted model can tell).

Defined results: null and empty texts have no language; rows without label or
text are no examples; a table without examples gives the plain model.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled texts that the model is fitted on, at most about.
ROWS = 8_000
#: Words it keeps, and the least number of texts a word must stand in.
WORDS, LEAST = 20_000, 4
#: Lead in log-odds that decides, and how much one word may add.
LEAD, CLIP = 3.0, 4.0
#: A text of at least so many words of which less than this share is known is in an unknown language.
MANY, KNOWN = 12, 0.25
UNKNOWN = "?"

_LETTERS = re.compile(r"[^\W\d_]+")

# Frequent words that tell four languages apart, for use without labelled texts.
STOPWORDS = {
    "en": "the of and is are was were to that it for with from by be this which then has have an at so if on or as what how answer result needs gives remain each every all steps after together adding count remove find question not we i but into than now would can still many much between while near week days hours minute litres once there more until also does".split(),
    "de": "der die das und ist sind war von zu den dem ein eine mit für auf im nicht es wird als auch wenn dann also nach noch hat aus bei einem eines wie viele zahl antwort lautet ergibt ergebnis braucht genau zusammen allen wert damit muss ich man bleiben weil durch jede jeden woche tagen zwischen davon während pro liter litern bereits kann bis insgesamt stunden was wieder mehr".split(),
    "fr": "le la les des et est sont du un une dans pour que qui sur avec il elle au aux ce cette ne pas plus par en donc réponse résultat reste restent après toutes étapes faut trouve valeur tout combien soit je si alors mais à font donne car de chaque jours près entre mesure litres minute pendant dont quand encore aussi même puis semaine heures déjà moins".split(),
    "es": "el la los las y es son del un una en para que con por se al lo le su más no como pero respuesta resultado entonces necesita queda quedan después todos pasos todo valor cuántos cuántas cuánto hay si luego así porque de a tras cada semana días entre mide litros minuto mientras cerca cuando todavía puede ya horas menos desde".split(),
}


class LanguageModel(NamedTuple):
    """``weights``: for each word its log-probability in each language, less that in its best one (0 to -CLIP)."""

    names: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    fitted: bool = False

    def language(self, text: str | None, lead: float = LEAD) -> str | None:
        """The text's language, ``UNKNOWN``, or null where there is no clear lead."""
        if not text:
            return None
        score = [0.0] * len(self.names)
        seen: dict[str, int] = {}
        for w in _LETTERS.findall(text.lower()):
            seen[w] = seen.get(w, 0) + 1
        known = 0
        for w, n in seen.items():
            of = self.weights.get(w)
            if of is not None:
                known += 1
                for i, v in enumerate(of):
                    # a word that is repeated tells little more
                    score[i] += v * min(n, 3)
        if self.fitted and len(seen) >= MANY and known < KNOWN * len(seen):
            return UNKNOWN
        if not known:
            return None
        order = sorted(range(len(score)), key=lambda i: -score[i])
        clear = len(order) < 2 or score[order[0]] - score[order[1]] >= lead
        return self.names[order[0]] if clear else None


def _model(counts: dict[str, dict[str, int]], texts: dict[str, int], fitted: bool) -> LanguageModel:
    names = tuple(sorted(texts))
    weights = {}
    for word, by in counts.items():
        logs = [math.log((by.get(n, 0) + 0.5) / (texts[n] + 1)) for n in names]
        best = max(logs)
        weights[word] = tuple(max(v - best, -CLIP) for v in logs)
    return LanguageModel(names, weights, fitted)


def plain() -> LanguageModel:
    """The model of the fixed lists."""
    counts: dict[str, dict[str, int]] = {}
    for name, found in STOPWORDS.items():
        for w in found:
            counts.setdefault(w, {})[name] = 4
    return _model(counts, dict.fromkeys(STOPWORDS, 9), False)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, words: int = WORDS) -> LanguageModel:
    """The model of a labelled table, from about ``rows`` of its texts."""
    given = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    every = max(1, labelled.count() // rows)
    sample = given.where(F.pmod(F.xxhash64(text_col), F.lit(every)) == 0).select(
        F.col(lang_col).alias("lang"), F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"\p{L}+"), F.lit(0))).alias("words")
    )
    # the empty word counts the texts; one row per language and word, the words are bounded
    found = sample.select("lang", F.explode(F.array_append("words", F.lit(""))).alias("word")).groupBy("word", "lang").agg(F.count("*").alias("n"))
    by_word = found.groupBy("word").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    top = by_word.where((F.col("n") >= LEAST) | (F.col("word") == "")).orderBy(F.col("n").desc(), "word").limit(words + 1).collect()
    counts = {r.word: r.by for r in top}
    texts = counts.pop("", {})
    return _model(counts, texts, True) if len(texts) > 1 and counts else plain()
