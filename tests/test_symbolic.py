from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import grading, symbolic

SAME = [
    (r"\frac12", "0.5"), (r"\frac{1}{2}", "0.5"), ("x+1", "1+x"), (r"\sqrt{12}", r"2\sqrt3"), (r"\frac{1}{\sqrt2}", r"\frac{\sqrt{2}}{2}"), ("(x+1)^2", "x^2+2x+1"),
    (r"2\frac{1}{2}", "2.5"), ("1,000", "1000"), (r"\{1,2\}", r"\{2,1\}"), ("x=5", "5"), (r"50\%", r"\frac{1}{2}"), (r"\frac{1}{1+\sqrt{2}}", r"\sqrt2-1"), (r"2\pi r", r"2r\pi"),
    (r"90^\circ", "90"), ("[0,1)", "[0, 1)"), (r"\sqrt[3]{8}", "2"), ("2^{-1}", "0.5"), ("x_1+x_2", "x_2+x_1"), (r"-\frac{3}{4}", r"\frac{-3}{4}"), ("3x/6", "x/2"),
    (r"\frac{x^2-1}{x-1}", "x+1"), ("1,2", "2,1"), ("8^{1/3}", "2"), (r"\sqrt{2}\sqrt{3}", r"\sqrt6"), (r"4\cdot 10^2", "400"), (r"\left(\frac{1}{2}, 3\right)", "(0.5,3)"),
]
OTHER = [
    ("(1,2)", "(2,1)"), (r"\text{no}", "no"), ("[0,1)", "[0,1]"), (r"\sqrt{x^2}", "x"), ("x_1", "x_2"), ("1/0", "1/0"), ("", ""), (r"\dfrac{1}{3}", "0.333"), ("x", "y"), ("3!", "6"), ("((((", "1"),
    ("1" * 200, "1" * 200), ("(" * 90 + "1" + ")" * 90, "2"), (r"\sqrt{-4}", "2"), ("x^{99}", "x^{99}"), (None, "1"), ("{1,2}", "{2,1}"),
]


@pytest.mark.parametrize("one, two", SAME)
def test_equal_by_value(one, two):
    assert symbolic.equal(one, two) and symbolic.equal(two, one)


@pytest.mark.parametrize("one, two", OTHER)
def test_not_equal_by_value(one, two):
    assert not symbolic.equal(one, two)


def shown(tree):
    op, *rest = tree
    if op == "n":
        return str(rest[0]) if rest[0] >= 0 else f"({rest[0]})"
    if op == "x":
        return "x"
    a, b = map(shown, rest)
    return {"+": f"({a}+{b})", "-": f"({a}-{b})", "*": rf"{a}\cdot {b}", "/": rf"\frac{{{a}}}{{{b}}}"}[op]


def value(tree, x):
    op, *rest = tree
    if op in "nx":
        return Fraction(rest[0]) if op == "n" else x
    a, b = (value(t, x) for t in rest)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b}[op]()


TREES = st.recursive(st.one_of(st.tuples(st.just("n"), st.integers(-4, 4)), st.just(("x",))), lambda t: st.tuples(st.sampled_from("+-*/"), t, t), max_leaves=6)


@settings(max_examples=400, deadline=None)
@given(TREES, TREES)
def test_equal_expressions_have_equal_values(one, two):
    def values(tree):
        out = []
        for k in range(1, 14):
            try:
                out.append(value(tree, Fraction(k * 7, 3)))
            except ZeroDivisionError:
                out.append(None)
        return out

    a, b = values(one), values(two)
    if any(v is None for v in a + b):
        return  # somewhere not defined: the quotients may still be equal
    assert symbolic.equal(shown(one), shown(two)) == (a == b)


def test_grades_by_value(spark):
    rows = [(r"so \boxed{\frac{1}{2}}", "0.5"), (r"\boxed{2}", "2"), (r"\boxed{x}", "y"), ("none", "1"), (r"\boxed{1}", None)]
    df = spark.createDataFrame(rows, "t string, g string")
    got = df.select(grading.grade("math_hard", F.col("t"), F.col("g"), symbolic=True).alias("r"), grading.grade("math_hard", F.col("t"), F.col("g")).alias("p")).collect()
    assert [r["r"]["correct"] for r in got] == [True, True, False, False, False] and [r["p"]["correct"] for r in got] == [False, True, False, False, False]
    assert [x[0] for x in df.select(symbolic.math_equal_symbolic(F.col("g"), F.col("g"))).collect()] == [True, True, True, True, None]
