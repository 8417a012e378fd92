"""Math answers: two normal forms and the comparison of a given answer with the true one.

The string part is a chain of built-in functions.  Only rows whose forms
differ and that may be compared as numbers reach the rational evaluator, an
Arrow function without ``eval``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.text import let, strip

# Units that an answer may carry.
UNITS = "degree cm centimeter meter mile second minute hour day week month year foot feet inch yard".split()
# Number words and their powers of ten.
POWERS = {"million": "*10^6", "billion": "*10^9", "trillion": "*10^12"}
# LaTeX commands and what they stand for in a plain expression.
SYMBOLS = {"\\cdot": "*", "\\times": "*", "\\div": "/", "\\pi": "pi", "\\infty": "inf", "\\cup": "U", "\\left": "", "\\right": "", "\\,": "", "\\;": "", "\\ ": " "}


def _chain(x: Column, steps: list[Callable[[Column], Column]]) -> Column:
    for step in steps:
        x = step(x)
    return x


def _drop(*literals: str) -> list[Callable[[Column], Column]]:
    return [lambda c, s=s: F.replace(c, F.lit(s), F.lit("")) for s in literals]


def _swap(old: str, new: str) -> Callable[[Column], Column]:
    return lambda c: F.replace(c, F.lit(old), F.lit(new))


def _sub(pattern: str, new: str) -> Callable[[Column], Column]:
    return lambda c: F.regexp_replace(c, pattern, new)


def short_form(answer: Column) -> Column:
    """Cleaned LaTeX: one spelling for fractions, roots, units, degrees and blanks."""
    start = F.regexp_replace(strip(answer), r"(?s)^\\text\{(.+?)\}$", "$1")
    cleaned = _chain(
        start,
        [
            *_drop("\n", "\\!"), _swap("\\\\", "\\"), _swap("tfrac", "frac"), _swap("dfrac", "frac"),
            *_drop("\\left", "\\right", "^{\\circ}", "^\\circ", "\\$"), _sub(r"(?s)\\text\{ .*$", ""), *_drop("\\%"),
            _swap(" .", " 0."), _swap("{.", "{0."), _sub(r"^\.", "0."), _sub(r"^[^=]{0,2}=([^=]*)$", "$1"),
            _sub(r"\\sqrt([^{])", r"\\sqrt{$1}"), *_drop(" "),
            _sub(r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), _sub(r"\\frac([^{])\{", r"\\frac{$1}{"),
            _sub(r"^0\.5$", r"\\frac{1}{2}"), _sub(r"^(0|-?[1-9]\d*)/(0|-?[1-9]\d*)$", r"\\frac{$1}{$2}"),
        ],
    )
    # two or more units: left as given
    return F.when(F.regexp_count(start, F.lit(r"\\text\{ ")) > 1, start).otherwise(cleaned)


def without_commas(x: Column) -> Column:
    """Numbers without separators of thousands."""
    return F.regexp_replace(x, r"(?<=\d),(?=\d{3}(?:\D|$|,\d{3}))", "")


def is_integer(x: Column) -> Column:
    n = without_commas(x).try_cast("double")
    return F.coalesce(F.abs(n - F.round(n)) <= 1e-7, F.lit(False))


def plain_latex(x: Column) -> Column:
    """Fractions as quotients, roots as ``sqrt``, symbols by name."""
    for a, b in (("\\tfrac", "\\frac"), ("\\dfrac", "\\frac"), ("\\frac", " \\frac")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "$1/$2")
    x = F.regexp_replace(x, r"\\sqrt\{([^{}]*)\}", "sqrt($1)")
    x = F.regexp_replace(x, r"\\(?:text|mathrm|mbox)\{([^{}]*)\}", "$1")
    for a, b in SYMBOLS.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return strip(x)


def long_form(answer: Column) -> Column:
    """Plain expression in lower case, without units, currency, blanks and braces."""
    units = [_sub(rf"{u}(es)?(s)? *(\^[0-9]+)?", "") for u in UNITS]
    text = _chain(
        answer,
        [
            _sub(r"(?s)^\\text\{(.+?)\}$", "$1"), _swap("\\%", "%"), _swap("\\$", "$"), *_drop("$", "%"), _swap(" or ", " , "), _swap(" and ", " , "),
            *[_swap(a, b) for a, b in POWERS.items()], *units, _sub(r"\^ *\\circ", ""), _sub(r"(?s)^\{(.*)\}$", "$1"), _sub(r",\\! *", ""),
            _sub(r"^\s*\+?(-?\d+)(?:\.0*)?\s*$", "$1"), plain_latex, _sub("- *", "-"), _sub(r"([0-9]) +(?=[0-9])", "$1+"), *_drop(" ", "{", "}"), F.lower,
        ],
    )
    # a whole number, with or without separators
    number = _chain(text, [*_drop(","), _sub(r"\.0*$", ""), _sub(r"^(-?)0+(?=\d)", "$1")])
    return F.when(text.rlike(r"^-?(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.0*)?$"), number).otherwise(text)


def elements(x: Column) -> Column:
    """Parts of a bracketed tuple or interval; else the text itself."""

    def parts(y: Column) -> Column:
        inside = F.nullif(F.regexp_extract(y, r"^[()\[\]]([^()\[\]]+)[()\[\]]$", 1), F.lit(""))
        return F.when(y == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.transform(F.split(inside, ","), strip), F.array(y)))

    return let(without_commas(x), parts)


def is_fraction(x: Column) -> Column:
    return x.rlike(r"^-?[0-9]+.?/0*[1-9][0-9]*.?$")


def may_evaluate(x: Column) -> Column:
    """At most two different letters and no power that could explode."""
    letters = F.array_distinct(F.regexp_extract_all(F.replace(F.replace(x, F.lit("sqrt"), F.lit("")), F.lit("frac"), F.lit("")), F.lit(r"(\p{L})"), 1))
    return (F.size(letters) <= 2) & ~x.rlike(r"\^[{(]|\^[0-9]+\^|\^[0-9][0-9]+")


class _Poly(dict):
    """Polynomial with rational coefficients: monomial (sorted letters) -> coefficient."""


def _poly(node: ast.expr) -> _Poly:
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return _Poly({(): Fraction(str(node.value))})
    if isinstance(node, ast.Name):
        return _Poly({(node.id,): Fraction(1)})
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        sign = -1 if isinstance(node.op, ast.USub) else 1
        return _Poly({k: sign * v for k, v in _poly(node.operand).items()})
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "sqrt" and len(node.args) == 1:
        inner = _poly(node.args[0])
        if set(inner) <= {()}:
            value = inner.get((), Fraction(0))
            root = Fraction(int(value.numerator**0.5 + 0.5), int(value.denominator**0.5 + 0.5)) if value >= 0 else None
            if root is not None and root * root == value:
                return _Poly({(): root})
            if value > 0:
                # a root that is no fraction: its square part goes outside
                n, d = value.numerator * value.denominator, value.denominator
                out = 1
                for f in range(2, 1000):
                    while n % (f * f) == 0:
                        n, out = n // (f * f), out * f
                return _Poly({(f"sqrt{n}",): Fraction(out, d)})
    if isinstance(node, ast.BinOp):
        a, b = _poly(node.left), _poly(node.right)
        if isinstance(node.op, (ast.Add, ast.Sub)):
            sign = 1 if isinstance(node.op, ast.Add) else -1
            out = _Poly(a)
            for k, v in b.items():
                out[k] = out.get(k, Fraction(0)) + sign * v
            return out
        if isinstance(node.op, ast.Div) and set(b) == {()} and b[()]:
            return _Poly({k: v / b[()] for k, v in a.items()})
        if isinstance(node.op, ast.Mult):
            return _times(a, b)
        if isinstance(node.op, ast.Pow) and set(b) == {()} and b[()].denominator == 1 and 0 <= b[()] <= 9:
            out = _Poly({(): Fraction(1)})
            for _ in range(int(b[()])):
                out = _times(out, a)
            return out
    raise ValueError("not a polynomial")


def _times(a: _Poly, b: _Poly) -> _Poly:
    out = _Poly()
    for x, v in a.items():
        for y, w in b.items():
            key, factor, seen = [], v * w, list(x)
            for z in y:
                if z.startswith("sqrt") and z in seen:
                    seen.remove(z)
                    factor *= int(z[4:])
                else:
                    key.append(z)
            k = tuple(sorted(seen + key))
            out[k] = out.get(k, Fraction(0)) + factor
    return out


_IMPLICIT = re.compile(r"(?<=[0-9)])(?=[A-Za-z(])|(?<=\))(?=[0-9])")


def equal_expressions(a: str, b: str) -> bool:
    """True if the difference of two polynomial expressions is 0."""
    try:
        parsed = ast.parse(_IMPLICIT.sub("*", f"({a})-({b})".replace("^", "**")), mode="eval")
        return all(v == 0 for v in _poly(parsed.body).values())
    except (ValueError, SyntaxError, ZeroDivisionError, RecursionError, MemoryError, OverflowError):
        return False


def grade(given: Column, truth: Column) -> Column:
    """True if the given answer is right; null answers are wrong.

    Equal by either normal form; else element by element: brackets agree,
    fractions agree as written, an integer only equals an integer, and what
    remains is compared as polynomials.
    """
    x, y = long_form(truth), long_form(given)
    a, b = elements(x), elements(y)
    plain = lambda z: (z["a"] == z["b"]) | (~(is_fraction(z["a"]) & is_fraction(z["b"])) & (is_integer(z["a"]) == is_integer(z["b"])))
    brackets = (F.size(a) <= 1) | ((F.substring(x, 1, 1) == F.substring(y, 1, 1)) & (F.substring(x, -1, 1) == F.substring(y, -1, 1)))
    could = (F.size(a) == F.size(b)) & brackets & F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), plain)
    settled = (
        F.when(given.isNull() | truth.isNull(), False)
        .when((short_form(truth) == short_form(given)) | (x == y), True)
        .when(y == "", False)
        .when(~(could & may_evaluate(F.concat(x, y))), False)
    )
    return F.coalesce(settled, _equal_lists(x, y), F.lit(False))


@F.pandas_udf(T.BooleanType())
def _equal_lists(a: pd.Series, b: pd.Series) -> pd.Series:
    def same(x: str | None, y: str | None) -> bool:
        if x is None or y is None:
            return False
        if x == y:
            return True
        m, n = (re.fullmatch(r"[()\[\]]([^()\[\]]+)[()\[\]]", z) for z in (x, y))
        xs, ys = (m.group(1).split(",") if m else [x]), (n.group(1).split(",") if n else [y])
        return len(xs) == len(ys) and all(p == q or equal_expressions(p, q) for p, q in zip(xs, ys, strict=True))

    return pd.Series([same(x, y) for x, y in zip(a, b, strict=True)])


def count_letters(x: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(x, F.lit(r"(\p{L})"), 1))).cast("long")
