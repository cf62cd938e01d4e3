"""Exact equality of short answers in LaTeX (F9): both sides as quotients of polynomials with rational coefficients.

A term is a product of symbols with rational exponents. Roots of numbers are powers of primes, whose whole part goes into the
coefficient, so \\sqrt{12} is 2\\sqrt{3} and 1/\\sqrt{2} is \\sqrt{2}/2. Quotients are compared by cross multiplication. What isn't such an
expression (words, relations, functions, roots of sums, powers beyond MOST) has no value and equals nothing.
"""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Characters of an answer, greatest power of a sum, terms of a polynomial, digits of a number: beyond, an answer has no value.
LONGEST, MOST, TERMS, DIGITS = 300, 24, 400, 40

_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|\d+(?:,\d{3})+(?!\d)(?:\.\d+)?|\d+\.?\d*|\.\d+|[A-Za-z]|\S")
_SIGNS = {"\\cdot": "*", "\\times": "*", "\\div": "/", "\\{": "{set", "\\}": "set}", "\\lbrack": "[", "\\rbrack": "]"}
_SILENT = {"\\left", "\\right", "\\!", "\\,", "\\;", "\\:", "\\ ", "\\displaystyle", "$", "\\$"}
_GREEK = re.compile(r"\\(?:pi|alpha|beta|gamma|theta|lambda|mu|phi|omega)$")


class NoValue(ValueError):
    pass


Poly = dict  # term (a sorted tuple of (symbol, exponent)) to coefficient


def number(x) -> Poly:
    return {(): Fraction(x)} if x else {}


def times(a: Poly, b: Poly) -> Poly:
    out: Poly = {}
    for s, x in a.items():
        for t, y in b.items():
            powers = dict(s)
            for name, e in t:
                powers[name] = powers.get(name, 0) + e
            c = x * y
            for name, e in list(powers.items()):
                if isinstance(name, int):  # a prime keeps an exponent below 1
                    c *= Fraction(name) ** (e.numerator // e.denominator)
                    powers[name] = e - e.numerator // e.denominator
            term = tuple(sorted(((n, e) for n, e in powers.items() if e), key=str))
            out[term] = out.get(term, 0) + c
    if len(out) > TERMS:
        raise NoValue
    return {t: c for t, c in out.items() if c}


def plus(a: Poly, b: Poly, sign: int = 1) -> Poly:
    out = dict(a)
    for t, c in b.items():
        out[t] = out.get(t, 0) + sign * c
    return {t: c for t, c in out.items() if c}


def primes(n: int) -> dict[int, int]:
    out, p = {}, 2
    while p * p <= n:
        if p > 10_000:
            raise NoValue
        while n % p == 0:
            out[p] = out.get(p, 0) + 1
            n //= p
        p += 1
    return out | ({n: out.get(n, 0) + 1} if n > 1 else {})


class Quotient:
    def __init__(self, top: Poly, below: Poly | None = None):
        self.top, self.below = top, number(1) if below is None else below
        if not self.below:
            raise NoValue

    def __add__(self, o):
        return Quotient(plus(times(self.top, o.below), times(o.top, self.below)), times(self.below, o.below))

    def __mul__(self, o):
        return Quotient(times(self.top, o.top), times(self.below, o.below))

    def __truediv__(self, o):
        return Quotient(times(self.top, o.below), times(self.below, o.top))

    def __neg__(self):
        return Quotient({t: -c for t, c in self.top.items()}, self.below)

    def __eq__(self, o):
        return not plus(times(self.top, o.below), times(o.top, self.below), -1)

    def power(self, e: Fraction) -> Quotient:
        if e.denominator == 1:
            if abs(e) > MOST:
                raise NoValue
            out = Quotient(number(1))
            for _ in range(abs(int(e))):
                out = out * self
            return out if e >= 0 else Quotient(number(1)) / out
        return Quotient(_root(self.top, e)) / Quotient(_root(self.below, e))

    def constant(self) -> Fraction:
        if any(x != {(): x.get((), 0)} for x in (self.top, self.below) if x):
            raise NoValue
        return Fraction(self.top.get((), 0)) / self.below[()]


def _root(p: Poly, e: Fraction) -> Poly:
    """A fractional power of one term with a positive coefficient."""
    if not p and e > 0:
        return {}
    if len(p) != 1 or abs(e) > MOST or e.denominator > MOST:
        raise NoValue
    ((term, c),) = p.items()
    if c <= 0 or any(not isinstance(n, int) for n, _ in term) and e.denominator % 2 == 0 and any(x % 2 == 0 for n, x in term if not isinstance(n, int)):
        raise NoValue  # even roots of even powers lose a sign
    powers = {n: x * e for n, x in term}
    for part, sign in ((c.numerator, 1), (c.denominator, -1)):
        for prime, k in primes(part).items():
            powers[prime] = powers.get(prime, Fraction(0)) + sign * k * e
    return times({(): Fraction(1)}, {tuple(powers.items()): Fraction(1)})


class Parser:
    """sum := product (+|- product)*; product := factor ((*|/)? factor)*; a factor may have a sign, a power and, behind a whole number, a
    fraction that is added."""

    def __init__(self, text: str):
        self.tokens = [_SIGNS.get(t, t) for t in _TOKEN.findall(text.replace("\\dfrac", "\\frac").replace("\\tfrac", "\\frac")) if t not in _SILENT]
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str = "") -> str:
        t = self.peek()
        if not t or wanted and t != wanted:
            raise NoValue
        self.at += 1
        return t

    def sum(self) -> Quotient:
        sign = self.peek() in ("+", "-") and self.take()
        out = -self.product() if sign == "-" else self.product()
        while self.peek() in ("+", "-"):
            out = out + (self.product() if self.take() == "+" else -self.product())
        return out

    def product(self) -> Quotient:
        out = self.factor()
        while True:
            t = self.peek()
            if t in ("*", "/"):
                self.take()
                out = out * self.factor() if t == "*" else out / self.factor()
            elif t in ("(", "{", "\\frac", "\\sqrt") or t.isalpha() or _GREEK.match(t) or t[:1].isdigit():
                out = out * self.factor()
            else:
                return out

    def factor(self) -> Quotient:
        if self.peek() == "-":
            self.take()
            return -self.factor()
        whole = self.peek().isdigit()
        out = self.atom()
        if whole and self.peek() == "\\frac":
            return out + self.atom()
        if self.peek() == "^":
            self.take()
            if self.peek() == "\\circ":
                self.take()
                return out
            out = out.power(self.argument().constant())
        if self.peek() in ("%", "\\%"):
            self.take()
            out = out / Quotient(number(100))
        return out

    def argument(self) -> Quotient:
        """A group in braces, or one character."""
        if self.peek() == "-":
            self.take()
            return -self.argument()
        t = self.peek()
        if len(t) > 1 and t.isdigit():  # \\frac12: a digit each
            self.tokens[self.at : self.at + 1] = list(t)
        return self.atom()

    def atom(self) -> Quotient:
        t = self.take()
        if t[0].isdigit() or t[0] == ".":
            if len(t) > DIGITS:
                raise NoValue
            return Quotient(number(Fraction(t.replace(",", ""))))
        if t in ("(", "{"):
            out = self.sum()
            self.take(")" if t == "(" else "}")
            return out
        if t == "\\frac":
            top = self.argument()
            return top / self.argument()
        if t == "\\sqrt":
            degree = Fraction(2)
            if self.peek() == "[":
                self.take()
                degree = self.sum().constant()
                self.take("]")
            if not degree:
                raise NoValue
            return self.argument().power(1 / degree)
        if len(t) == 1 and t.isalpha() or _GREEK.match(t):
            name = t
            if self.peek() == "_":
                self.take()
                self.at, start = self.at, self.at
                self.argument()
                name += "_" + "".join(self.tokens[start : self.at])
            return Quotient({((name, Fraction(1)),): Fraction(1)})
        raise NoValue

    def value(self) -> tuple:
        """The brackets around the answer and its parts: one, or as many as commas part in a tuple, an interval or a set."""
        named = re.fullmatch(r"[A-Za-z]", self.peek()) and self.tokens[1:2] == ["="]
        self.at = 2 if named else 0
        start = self.at
        try:
            out = self.sum()
            if self.at == len(self.tokens):
                return "", [out]
        except NoValue:
            pass
        self.at = start
        opened = self.take() if self.peek() in ("(", "[", "{set") else ""
        parts = [self.sum()]
        while self.peek() == ",":
            self.take()
            parts.append(self.sum())
        closed = self.take() if opened else ""
        if self.at != len(self.tokens) or closed not in {"": ("",), "(": (")", "]"), "[": (")", "]"), "{set": ("set}",)}[opened]:
            raise NoValue
        return opened + closed, parts


def equal(one: str | None, two: str | None) -> bool:
    """True if both have a value and it is the same; parts of a set and of a bare list may come in any order."""
    if one is None or two is None or max(len(one), len(two)) > LONGEST:
        return False
    try:
        (a, left), (b, right) = Parser(one).value(), Parser(two).value()
        if a != b or len(left) != len(right):
            return False
        if a not in ("", "{setset}"):
            return all(x == y for x, y in zip(left, right, strict=True))
        rest = list(right)
        for x in left:
            if not any(x == y and not rest.pop(k) is None for k, y in enumerate(rest)):
                return False
        return True
    except (NoValue, ZeroDivisionError, OverflowError, RecursionError):
        return False


@F.pandas_udf(BooleanType())
def _equal(one: pd.Series, two: pd.Series) -> pd.Series:
    known: dict = {}
    out = []
    for pair in zip(one, two, strict=True):
        if pair not in known:
            known[pair] = isinstance(pair[0], str) and isinstance(pair[1], str) and equal(*pair)
        out.append(known[pair])
    return pd.Series(out)


def math_equal_symbolic(pred: Column, gold: Column) -> Column:
    """equal after normalisation, or else by value. Only pairs that aren't equal as text reach Python, each distinct one of a
    batch once. Null if either is null."""
    from .grading import math_equal

    same = math_equal(pred, gold)
    return F.when(same.isNull(), F.lit(None)).otherwise(same | _equal(F.when(~same, pred), F.when(~same, gold)))
