"""Grading mathematical answers: an answer is read into trees, and trees are compared.

One lexer reads LaTeX and plain text alike. What it yields is split into elements (of a tuple, an
interval, or a list with commas, "or", "and"), and each element is parsed into a tree of numbers,
letters and operations; what is no expression stays text. Elements are equal if they read the same,
or if their trees have the same value: in exact fractions, or, with roots, pi or letters, at several
random complex points. Expressions are never evaluated by the interpreter. Differs from a computer
algebra system for functions other than square roots.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from evalanvil.functions.keys import py_strip
from evalanvil.functions.text import math_extract, normalize_numeric

# Words of scale, and units, which don't count (nor do their plurals and powers).
SCALES = {"million": 6, "billion": 9, "trillion": 12}
UNITS = ("degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard")
#: What a sign or command stands for; other commands stand for nothing.
MEANING = {
    "\\pi": "pi", "π": "pi", "\\infty": "inf", "∞": "inf", "\\cup": "U", "∪": "U", "\\cdot": "*", "·": "*", "\\times": "*", "×": "*", "\\div": "/", "÷": "/", "√": "sqrt", "\\sqrt": "sqrt",
    "\\frac": "frac", "\\dfrac": "frac", "\\tfrac": "frac", "\\le": "≤", "\\leq": "≤", "\\ge": "≥", "\\geq": "≥", "\\neq": "≠", "\\pm": "±", "\\{": "(", "\\}": ")", "−": "-",
}
PROSE = ("\\text", "\\mathrm", "\\mathbf", "\\mbox", "\\textbf")
NAMES = ("pi", "inf", "sqrt", "frac")
#: Exact values of more binary digits are not worked out; such answers are compared as they are written.
LARGEST = 100_000

_LEX = re.compile(r"(?P<number>\d{1,3}(?:,\d{3})+(?!\d)(?:\.\d+)?|\d+(?:\.\d*)?|\.\d+)|(?P<command>\\(?:[A-Za-z]+|.))|(?P<word>[^\W\d_]+)|(?P<gap>\s+)|(?P<sign>.)", re.S)
_UNIT = re.compile(rf"(?:{'|'.join(UNITS)})(?:es|s)?", re.I)


class NoExpression(ValueError):
    """Text that is no expression."""


@dataclass(frozen=True)
class Token:
    kind: str  # number, name (of NAMES), letter, sign
    text: str
    gap: bool = False  # whether white space stood before it


def tokens_of(answer: str) -> list[Token]:
    """An answer as tokens, without what doesn't count: signs of currency and per cent, spacing, degrees, units."""
    out: list[Token] = []
    found = [(m.lastgroup, m.group()) for m in _LEX.finditer(answer)]
    i, gap = 0, False
    while i < len(found):
        kind, text = found[i]
        i += 1
        if kind == "gap":
            gap = True
            continue
        if text in PROSE and i < len(found) and found[i][1] == "{":
            inside, i = _braced(found, i)
            if not out:  # later text is a unit or a remark
                out += tokens_of(inside)
            continue
        text = MEANING.get(text, "" if kind == "command" else text)
        if text in ("", "$", "%"):
            continue
        if kind == "number":
            out.append(Token("number", text.replace(",", ""), gap))
        elif text in NAMES:
            out.append(Token("name", text, gap))
        elif kind == "word" and out and text.lower() in SCALES and out[-1].kind == "number":
            out[-1] = Token("number", f"{Decimal(out[-1].text).scaleb(SCALES[text.lower()]):f}", out[-1].gap)
        elif kind == "word" and out and _UNIT.fullmatch(text):
            power = re.match(r"\s*\^\s*(?:\d|\{\s*\d\s*\})", "".join(x for _, x in found[i : i + 8]))
            i += 0 if power is None else len([*_LEX.finditer(power.group())])
        elif kind == "word":
            out += _spelled(text, gap, out)
        else:
            out.append(Token("sign", text, gap))
        gap = False
    return _without_degrees(out)


def _braced(found: list[tuple[str, str]], i: int) -> tuple[str, int]:
    """The text of a braced group that opens at i, and what comes after it."""
    depth, parts = 0, []
    for j in range(i, len(found)):
        depth += (found[j][1] == "{") - (found[j][1] == "}")
        if not depth:
            return "".join(parts[1:]), j + 1
        parts.append(found[j][1])
    return "".join(parts[1:]), len(found)


def _spelled(word: str, gap: bool, before: list[Token]) -> list[Token]:
    """A word as tokens: a separator, a name or its letters."""
    low = word.lower()
    if low in ("or", "and") and before:
        return [Token("sign", ",", gap)]
    if low in NAMES:
        return [Token("name", low, gap)]
    return [Token("letter", c, gap and i == 0) for i, c in enumerate(low)]


def _without_degrees(tokens: list[Token]) -> list[Token]:
    """Tokens without a `^` that has lost what stood after it (a circle of degrees)."""
    out: list[Token] = []
    i = 0
    while i < len(tokens):
        rest = [t.text for t in tokens[i + 1 : i + 3]]
        if tokens[i].text == "^" and (not rest or rest == ["{", "}"] or rest[0] in (",", ")", "]")):
            i += 3 if rest == ["{", "}"] else 1
            continue
        out.append(tokens[i])
        i += 1
    return out


class _Parser:
    """Trees: a Fraction, a letter or 'pi' or 'inf', ('neg', a), ('sqrt', a), and ('+', a, b) likewise with - * / and ^."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.i = tokens, 0

    def text(self, ahead: int = 0) -> str:
        return self.tokens[self.i + ahead].text if self.i + ahead < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> Token:
        if self.i >= len(self.tokens) or wanted is not None and self.text() != wanted:
            raise NoExpression
        self.i += 1
        return self.tokens[self.i - 1]

    def whole(self):
        tree = self.sum()
        if self.i < len(self.tokens):
            raise NoExpression
        return tree

    def sum(self):
        tree = self.product()
        while self.text() in ("+", "-"):
            tree = (self.take().text, tree, self.product())
        return tree

    def product(self):
        tree = self.signed()
        while True:
            t = self.text()
            if t in ("*", "/"):
                tree = (self.take().text, tree, self.signed())
            elif t and (t in ("(", "{") or self.tokens[self.i].kind in ("number", "name", "letter")):
                mixed = isinstance(tree, Fraction) and tree.denominator == 1 and self._fraction_follows()
                right = self.signed() if not mixed else self._fraction()
                tree = ("+" if mixed else "*", tree, right)
            else:
                return tree

    def _fraction_follows(self) -> bool:
        """Whether two numbers follow, one over the other: then a whole number before them is added."""
        if self.text() == "frac":
            return True
        kinds = [t.kind for t in self.tokens[self.i : self.i + 3]]
        return kinds == ["number", "sign", "number"] and self.text(1) == "/"

    def _fraction(self):
        if self.text() == "frac":
            return self.atom()
        a = self.atom()
        self.take("/")
        return ("/", a, self.atom())

    def signed(self):
        if self.text() in ("+", "-"):
            sign = self.take().text
            tree = self.signed()
            return ("neg", tree) if sign == "-" else tree
        tree = self.atom()
        if self.text() == "^" or self.text() == self.text(1) == "*":
            self.i += 1 if self.text() == "^" else 2
            return ("^", tree, self.signed())
        return tree

    def atom(self):
        t = self.take()
        if t.text in ("(", "{"):
            tree = self.sum()
            self.take(")" if t.text == "(" else "}")
            return tree
        if t.text == "sqrt":
            return ("sqrt", self.part())
        if t.text == "frac":
            return ("/", self.part(), self.part())
        if t.kind == "number":
            return Fraction(t.text.rstrip(".") if t.text != "." else "0")
        if t.kind == "letter" or t.text in ("pi", "inf"):
            return t.text
        raise NoExpression

    def part(self):
        """What a root or fraction takes: a group, or one digit or sign as in \\frac12."""
        t = self.tokens[self.i] if self.i < len(self.tokens) else None
        if t is not None and t.kind == "number" and len(t.text) > 1 and t.text.isdigit() and not t.gap:
            self.tokens = [*self.tokens[: self.i], Token("number", t.text[0]), Token("number", t.text[1:]), *self.tokens[self.i + 1 :]]
        return self.atom()


def shown(tree) -> str:
    """A tree as text, the same for all spellings that give the tree."""
    if isinstance(tree, Fraction):
        return str(tree)
    if isinstance(tree, str):
        return tree
    op, *args = tree
    if op in ("neg", "sqrt"):
        return f"{op}({shown(args[0])})"
    return f"({shown(args[0])}){op}({shown(args[1])})"


@dataclass(frozen=True)
class Element:
    text: str
    tree: object = None


@dataclass(frozen=True)
class Answer:
    """What an answer says: its elements, and the brackets around them if there are several."""

    brackets: tuple[str, str]
    elements: tuple[Element, ...]


def read_answer(answer: str) -> Answer:
    """An answer as elements; a name of up to two letters before an equals sign is left out."""
    tokens = tokens_of(answer)
    equals = [i for i, t in enumerate(tokens) if t.text == "="]
    if len(equals) == 1 and 0 < equals[0] <= 2 and equals[0] + 1 < len(tokens):
        tokens = tokens[equals[0] + 1 :]
    brackets, inside = ("", ""), tokens
    if len(tokens) > 2 and tokens[0].text in ("(", "[") and tokens[-1].text in (")", "]") and _splits(tokens[1:-1])[1:]:
        brackets, inside = (tokens[0].text, tokens[-1].text), tokens[1:-1]
    return Answer(brackets, tuple(_element(part) for part in _splits(inside)))


def _splits(tokens: list[Token]) -> list[list[Token]]:
    """Tokens between commas that are in no bracket; brackets that don't match make one part."""
    parts, depth = [[]], 0
    for t in tokens:
        depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
        if depth < 0:
            return [tokens]
        if t.text == "," and not depth:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts if not depth else [tokens]


def _element(tokens: list[Token]) -> Element:
    plain = "".join(t.text.lower() for t in tokens if t.text not in ("{", "}"))
    if not tokens:
        return Element("")
    try:
        tree = _Parser(tokens).whole()
        return Element(shown(tree), tree)
    except (NoExpression, RecursionError):
        return Element(plain)


def _letters(tree) -> set[str]:
    """Letters, 'pi', 'inf' and 'sqrt' of a tree; '?' if a power is one that is not worked out."""
    if isinstance(tree, Fraction):
        return set()
    if isinstance(tree, str):
        return {tree}
    op, *args = tree
    own = {"sqrt"} if op == "sqrt" else set()
    if op == "^" and not (isinstance(args[1], str) or isinstance(args[1], Fraction) and args[1] in range(10)):
        own = {"?"}
    return own.union(*map(_letters, args))


def _value(tree, at: dict[str, complex] | None):
    """The value of a tree, exact without `at`."""
    if isinstance(tree, Fraction):
        return tree if at is None else complex(tree)
    if isinstance(tree, str):
        return at[tree]
    op, *args = tree
    v = [_value(a, at) for a in args]
    if op == "neg":
        return -v[0]
    if op == "sqrt":
        return v[0] ** 0.5
    if op == "^":
        if at is None and v[0].numerator.bit_length() * int(v[1]) + v[0].denominator.bit_length() * int(v[1]) > LARGEST:
            raise OverflowError
        return v[0] ** (int(v[1]) if at is None else v[1])
    return {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b}[op](*v)


def same_value(a, b) -> bool:
    """Whether two trees have the same value: exactly, or at random complex points (of both signs, so that a root of a square is not its base)."""
    names = _letters(a) | _letters(b)
    letters = sorted(n for n in names if len(n) == 1 and n != "?")
    if "?" in names or "inf" in names or len(letters) > 2:
        return False
    try:
        if not names:
            return _value(a, None) == _value(b, None)
        rng = random.Random(11)
        for _ in range(8):
            at = {n: complex(rng.uniform(-2.5, 2.5), rng.uniform(-1.5, 1.5)) for n in letters} | {"pi": complex(math.pi)}
            x, y = _value(a, at), _value(b, at)
            if not abs(x - y) <= 1e-9 * max(1.0, abs(x), abs(y)):
                return False
        return True
    except (ZeroDivisionError, OverflowError, RecursionError, ValueError):
        return False


def _unsigned(tree):
    return _unsigned(tree[1]) if isinstance(tree, tuple) and tree[0] == "neg" else tree


def is_whole(e: Element) -> bool:
    """Whether an element is a whole number as it stands."""
    t = _unsigned(e.tree)
    return isinstance(t, Fraction) and t.denominator == 1


def is_fraction(e: Element) -> bool:
    """Whether an element is one whole number over another as it stands."""
    t = _unsigned(e.tree)
    return isinstance(t, tuple) and t[0] == "/" and all(isinstance(x, Fraction) and x.denominator == 1 for x in map(_unsigned, t[1:]))


def same_element(a: Element, b: Element) -> bool:
    """Equal as read; or by value, but not two fractions (an unreduced one is wrong) nor a whole number and another form."""
    if a.text == b.text:
        return bool(a.text)
    if a.tree is None or b.tree is None or is_fraction(a) and is_fraction(b) or is_whole(a) != is_whole(b):
        return False
    return same_value(a.tree, b.tree)


def grade_answer(given: str | None, gold: str | None) -> bool:
    """Whether an answer equals the gold answer: as many elements, in the same brackets, each the same."""
    if given is None or gold is None:
        return False
    if given.strip() == gold.strip():
        return bool(given.strip())
    a, b = read_answer(gold), read_answer(given)
    return len(a.elements) == len(b.elements) and a.brackets == b.brackets and all(map(same_element, a.elements, b.elements))


@pandas_udf(BooleanType())
def grade_answers(given: pd.Series, gold: pd.Series) -> pd.Series:
    """grade_answer over Arrow batches; an answer that breaks the grader is wrong."""

    def one(a, b):
        try:
            return grade_answer(a, b)
        except (ValueError, RecursionError, OverflowError):
            return False

    return pd.Series([one(a, b) for a, b in zip(given, gold)], dtype=bool)


#: Ways in which an answer is judged, for histograms over a fixed domain.
METHODS = ("prm800k", "robust_boxed", "no_match", "failed")


def grade_math(df: DataFrame, response: Column, gold: Column) -> DataFrame:
    """df with extracted, method and is_correct.

    Extraction, the numeric comparison and the cascade are native; only the equivalence is Python.
    method is 'failed' without an answer, 'prm800k' if equivalent, 'robust_boxed' if only the numbers
    as text agree, else 'no_match'. Null responses or gold answers are wrong.
    """
    extracted = math_extract(response)
    expected = py_strip(gold)
    out = df.withColumn("extracted", extracted).withColumn("__gold", expected)
    # what is equal as text needs no reading
    equal = F.coalesce((F.col("extracted") == F.col("__gold")) & (F.col("__gold") != ""), F.lit(False))
    out = out.withColumn("__same", equal | grade_answers(F.when(~equal, F.col("extracted")), F.col("__gold")))
    numbers = F.coalesce(normalize_numeric(F.col("extracted")) == normalize_numeric(F.col("__gold")), F.lit(False))
    method = (
        F.when(F.col("extracted").isNull(), "failed").when(F.col("__same"), "prm800k").when(numbers, "robust_boxed").otherwise("no_match")
    )
    return out.withColumn("method", method).withColumn("is_correct", F.col("method").isin("prm800k", "robust_boxed")).drop("__gold", "__same")
