"""A small evaluator for arithmetic written in answers. Nothing is ever executed as code."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(?:(\d+\.\d*|\.\d+|\d+)|(\*\*|//|[-+*/()]))")
#: Powers are evaluated up to this size of base and exponent.
POWER_BASE, POWER = 10_000, 64


class _Unreadable(Exception):
    pass


def _lex(text: str) -> list:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise _Unreadable
        if m[1]:
            if len(m[1]) > 1 and m[1].isdigit() and m[1][0] == "0" and m[1].strip("0"):
                raise _Unreadable  # a number with a leading zero
            out.append(float(m[1]) if "." in m[1] else int(m[1]))
        else:
            out.append(m[2])
        at = m.end()
    return out


def _apply(op: str, a, b):
    if op == "**":
        if abs(a) > POWER_BASE or abs(b) > POWER:
            raise _Unreadable
        value = a**b
        if isinstance(value, complex):
            raise _Unreadable
        return value
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "//": lambda: a // b}[op]()


_BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "**": 4}
_SIGN = 3


def evaluate(text: str | None) -> float | None:
    """Value of + - * / // ** and parentheses over numbers, precedence as in Python; None if it has none.

    Division by zero, numbers with leading zeros and powers beyond the bounds have no value.
    """
    try:
        values: list = []
        pending: list[str] = []

        def reduce() -> None:
            op = pending.pop()
            if op in ("u+", "u-"):
                values.append(-values.pop() if op == "u-" else values.pop())
            else:
                b, a = values.pop(), values.pop()
                values.append(_apply(op, a, b))

        def rank(op: str) -> int:
            return _SIGN if op in ("u+", "u-") else _BINDS[op]

        operand = True
        for token in _lex(text or ""):
            if not isinstance(token, str):
                if not operand:
                    return None
                values.append(token)
                operand = False
            elif token == "(":
                if not operand:
                    return None
                pending.append(token)
            elif token == ")":
                if operand:
                    return None
                while pending and pending[-1] != "(":
                    reduce()
                if not pending:
                    return None
                pending.pop()
            elif operand:
                if token not in "+-":
                    return None
                pending.append("u" + token)
            else:
                right = token == "**"
                while pending and pending[-1] != "(" and (rank(pending[-1]) > rank(token) or rank(pending[-1]) == rank(token) and not right):
                    reduce()
                pending.append(token)
                operand = True
        if operand:
            return None
        while pending:
            if pending[-1] == "(":
                return None
            reduce()
        value = float(values.pop())
        return value if not values and value == value and abs(value) != float("inf") else None
    except (_Unreadable, ZeroDivisionError, OverflowError, IndexError):
        return None
