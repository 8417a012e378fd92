"""Operators that need a model or a parser: interfaces and offline stand-ins.

A :class:`Generator` maps prompts to answers.  It runs inside ``mapInPandas``,
one instance per partition, and results are joined by id, never by position.
The stand-ins are deterministic, so that pipelines can be run and tested
without a network.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from html.parser import HTMLParser
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Generator(Protocol):
    """Answers prompts; may raise."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


class EchoGenerator:
    """Stand-in: answers with the last line of the prompt."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [p.strip().rsplit("\n", 1)[-1] for p in prompts]


class HashJudge:
    """Stand-in for a judge: a score from 0 to 10 that depends on the prompt alone."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [f"Score: {int(hashlib.md5(p.encode()).hexdigest(), 16) % 11}" for p in prompts]


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest(), 16)


class FunctionWriter:
    """Stand-in for a writer of checking functions: a name of the registry and three cases, or now and then nothing usable."""

    NAMES = ("upper_case_forward", "lower_case_forward", "commas_to_semicolons_forward", "full_stops_to_exclamation_marks_forward")
    INPUTS = ("AB.", "ab;", "Ab, c")

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self._one(_number(p)) for p in prompts]

    def _one(self, n: int) -> str:
        if n % 7 == 0:
            return "I have no function for that."
        cases = [{"input": x, "output": "True" if n // 2**i % 2 else "False"} for i, x in enumerate(self.INPUTS)]
        return "```json\n" + json.dumps({"func": self.NAMES[n % 4] + "\nimport requests", "cases": cases}) + "\n```"


class BackTranslator:
    """Stand-in: three instructions for a function, the last one negated for some."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [json.dumps(["Write so that it holds.", "Follow it.", "Do not follow it." if _number(p) % 5 == 0 else "Keep to it."]) for p in prompts]


class CaseResponder:
    """Stand-in for a writer of responses: the query in capitals, in small letters or as it is."""

    def __call__(self, prompts: list[str]) -> list[str]:
        forms = (str.upper, str.lower, str)
        return [forms[_number(p) % 3](p.rsplit("[Query] ", 1)[-1]) for p in prompts]


class ChunkAnnotator:
    """Stand-in for an annotator: for each numbered chunk its last number as result; every seventh prompt gets no list."""

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            found = re.findall(r"(?m)^\[(\d+)\] (.*)$", p)
            rows = [{"id": i, "result": (re.findall(r"[0-9]+", c) or [""])[-1], "correct": True} for i, c in found]
            out.append("none" if _number(p) % 7 == 0 else "```json\n" + json.dumps(rows) + "\n```")
        return out


def call_with_retry(generator: Generator, prompts: list[str], tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Answers, trimmed and without an echoed prompt; empty after ``tries`` failures, with waits that double."""
    for n in range(tries):
        try:
            answers = generator(prompts)
            return [a.removeprefix(p).strip() for p, a in zip(prompts, answers, strict=True)]
        except Exception:
            if n + 1 < tries:
                sleep(wait * 2**n)
    return [""] * len(prompts)


def generated(
    rows: DataFrame, generator: Callable[[], Generator], *, prompt_col: str = "prompt", out_col: str = "answer", batch: int = 20, parallel: int = 1, tries: int = 3,
) -> DataFrame:
    """Rows with the generator's answer to ``prompt_col``; ``parallel`` batches are under way at once per task."""
    schema = T.StructType(rows.schema.fields + [T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = generator()
        for b in batches:
            prompts = b[prompt_col].fillna("").tolist()
            parts = [prompts[i : i + batch] for i in range(0, len(prompts), batch)]
            with ThreadPoolExecutor(max(1, parallel)) as pool:
                answers = [a for part in pool.map(lambda x: call_with_retry(g, x, tries), parts) for a in part]
            yield b.assign(**{out_col: answers})

    return rows.mapInPandas(run, schema)


def generated_by_length(
    rows: DataFrame, generator: Callable[[], Generator], *, prompt_col: str = "prompt", out_col: str = "answer", batch: int = 16, width: int = 20_000, stops: tuple[str, ...] = (),
) -> DataFrame:
    """As :func:`generated`, but prompts of like length go together, long ones in smaller batches.

    Within each task rows are sorted by length; nothing is shuffled.  Answers
    stay in the row of their prompt and end before the first stop mark.
    """
    schema = T.StructType(rows.schema.fields + [T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = generator()
        for b in batches:
            prompts = b[prompt_col].fillna("").tolist()
            order = sorted(range(len(prompts)), key=lambda i: len(prompts[i]))
            answers = [""] * len(prompts)
            at = 0
            while at < len(order):
                bucket = len(prompts[order[at]]) // width
                part = [i for i in order[at : at + max(1, batch // (1 + bucket))] if len(prompts[i]) // width == bucket]
                for i, a in zip(part, call_with_retry(g, [prompts[i] for i in part]), strict=True):
                    answers[i] = min((a.split(s, 1)[0] for s in stops), key=len, default=a)
                at += len(part)
            yield b.assign(**{out_col: answers})

    return rows.mapInPandas(run, schema)


class _Checker(HTMLParser):
    """Counts tags that are closed without being open, or left open."""

    # Elements without an end tag.
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__()
        self.open: list[str] = []
        self.errors = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in self.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                self.errors += 1
        else:
            self.errors += 1


def _html_errors(text: str | None) -> int | None:
    if text is None:
        return None
    c = _Checker()
    c.feed(text)
    c.close()
    return c.errors + len(c.open) + ("<" not in text)


@F.pandas_udf(T.LongType())
def _html_errors_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_html_errors).astype("Int64")


def html_errors(text: Column) -> Column:
    """Errors of nesting in an HTML text; a text without any tag has one."""
    return _html_errors_udf(text)


# Frequent words by language.
FREQUENT = {
    "en": "the of and is are to that it for with not we this from then which",
    "de": "der die das und ist nicht ein eine mit für auf den dann also wenn von",
    "fr": "le les des et est une dans pour que qui pas sur avec du donc si",
    "es": "el los las y es una en para que con por no del entonces si se",
}


def detect_language(text: Column) -> Column:
    """Language with most frequent words in the text, ties by code; null where there are none."""
    found = F.split(F.lower(text), r"[^\p{L}]+")

    def count(words: Column, code: str) -> Column:
        return F.struct((-F.size(F.filter(words, lambda w: w.isin(FREQUENT[code].split())))).alias("n"), F.lit(code).alias("code"))

    best = F.element_at(F.transform(F.array(found), lambda w: F.array_min(F.array(*[count(w, c) for c in sorted(FREQUENT)]))), 1)
    return F.when(best["n"] < 0, best["code"])


def translated(rows: DataFrame, translator: Callable[[], Callable[[list[str], str], list[str]]], language: str, text_col: str = "text") -> DataFrame:
    """Rows with ``new_text`` from a translator, made once per partition."""
    schema = T.StructType(rows.schema.fields + [T.StructField("new_text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        go = translator()
        for b in batches:
            yield b.assign(new_text=go(b[text_col].fillna("").tolist(), language))

    return rows.mapInPandas(run, schema)


class TagTranslator:
    """Stand-in: marks the text with the language it should be in."""

    def __call__(self, texts: list[str], language: str) -> list[str]:
        return [f"[{language}] {x}" for x in texts]


class WordOverlapNli:
    """Stand-in for an inference model: entailment, neutral or contradiction by shared words and negation."""

    NEGATION = frozenset("not no never without avoid nicht kein pas sans sin nunca".split())

    def label(self, a: str, b: str) -> str:
        x, y = set(a.lower().split()), set(b.lower().split())
        if bool(x & self.NEGATION) != bool(y & self.NEGATION):
            return "contradiction"
        return "entailment" if len(x & y) * 2 >= min(len(x), len(y)) > 0 else "neutral"
