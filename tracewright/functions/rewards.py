"""Rewards of number-puzzle completions (F36-F39), over the one grader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grading
from .text import with_answer_container

SHAPES = ("attempt", "paper", "shaped")


def _skeleton(text: Column, strict: bool) -> Column:
    """A reasoning block (numbered ones count unless strict) and exactly one answer container."""
    think = r"(?is)<think>.*?</think>" if strict else r"(?is)<think\d*>.*?</think\d*>"
    count = lambda p: F.regexp_count(text, F.lit(p))
    answers = count(r"(?is)<answer>.*?</answer>")
    groups = count(r"(?is)<group_(?:consensus|solution)>.*?</group_(?:consensus|solution)>")
    n = answers if strict else F.when(answers > 0, answers).otherwise(groups)
    return F.regexp_like(text, F.lit(think)) & (n == 1)


def format_reward(text: Column, strict: bool = False) -> Column:
    """F36"""
    return _skeleton(text, strict).cast("double")


def _grade(text: Column, target: Column, nums: Column) -> Column:
    return grading.grade_equation(with_answer_container(text), target, nums)


def accuracy_reward(text: Column, target: Column, nums: Column) -> Column:
    """F37"""
    return _grade(text, target, nums)["correct"].cast("double")


def attempt_reward(text: Column, nums: Column, strict: bool = False) -> Column:
    """the skeleton around an expression that uses each number once, whatever its value."""
    expr = grading.countdown_expression(with_answer_container(text))
    sound = grading.is_arithmetic(expr) & grading.uses_each_once(expr, nums)
    return (_skeleton(text, strict) & F.coalesce(sound, F.lit(False))).cast("double")


def shaped_reward(text: Column, target: Column, nums: Column) -> Column:
    """1 if right; else a tenth of how near a sound expression's value comes."""
    expr = grading.countdown_expression(with_answer_container(text))
    sound = grading.is_arithmetic(expr) & grading.uses_each_once(expr, nums)
    value = grading.arithmetic_value(F.when(sound, expr))
    near = F.greatest(F.lit(0.0), 1 - F.abs(value - target) / F.greatest(F.abs(target), F.lit(1)))
    return F.when(F.abs(value - target) < 1e-6, 1.0).when(value.isNotNull(), 0.1 * near).otherwise(0.0)


def countdown_reward(text: Column, target: Column, nums: Column, shape: str = "attempt", strict: bool = False) -> Column:
    """the reward in one of three shapes."""
    if shape not in SHAPES:
        raise ValueError(f"a reward's shape is one of {SHAPES}, not {shape!r}")
    if shape == "shaped":
        return shaped_reward(text, target, nums)
    extra = attempt_reward(text, nums, strict) if shape == "attempt" else format_reward(text, strict)
    return 0.9 * accuracy_reward(text, target, nums) + 0.1 * extra


def with_rewards(df: DataFrame, text: Column, target: Column, nums: Column, strict: bool = False) -> DataFrame:
    """df with the reward in every shape (F36-F39) and `accuracy`; the equation is found and evaluated once."""
    rows = grading.with_equation(df, with_answer_container(text), target, nums, "_equation")
    accuracy = F.col("_equation.correct").cast("double")
    skeleton = _skeleton(text, strict)
    value = F.col("_equation.value")
    near = F.greatest(F.lit(0.0), 1 - F.abs(value - target) / F.greatest(F.abs(target), F.lit(1)))
    return rows.withColumns(
        {
            "accuracy": accuracy,
            "attempt": 0.9 * accuracy + 0.1 * (skeleton & F.col("_equation.sound")).cast("double"),
            "paper": 0.9 * accuracy + 0.1 * skeleton.cast("double"),
            "shaped": F.when(F.col("_equation.correct"), 1.0).when(value.isNotNull(), 0.1 * near).otherwise(0.0),
        }
    ).drop("_equation")
