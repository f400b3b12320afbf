"""Scalar and array helpers, all built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters str.strip removes beyond Java's Unicode white space class.
_EXTRA_WHITESPACE = r"\x1c-\x1f"
_STRIP_PATTERN = rf"(?U)\A[\s{_EXTRA_WHITESPACE}]+|[\s{_EXTRA_WHITESPACE}]+\z"


def checked(df: DataFrame, fits: Column, problem: Column | str) -> DataFrame:
    """``df``, or an error with ``problem`` at the first row for which ``fits`` is not true.

    The check is a filter: unlike a check inside an output column it stays in the plan when
    that column is not read.
    """
    text = F.lit(problem) if isinstance(problem, str) else problem
    return df.filter(F.when(fits, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def evaluated_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns that later filters and projections read instead of evaluating them again.

    Catalyst writes the expression of a projected column into every filter and projection that
    reads it. A generator of one row stands in between: nothing is pushed below it or merged with it.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*[name for name in df.columns if name not in columns], F.inline(F.array(row)))


def named_key(problem: str, *keys: str) -> Column:
    """``problem`` with the row's key behind it; null keys are named too."""
    parts = [F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit("null"))) for key in keys]
    return F.concat_ws(" ", F.lit(f"{problem}:"), *parts)


def win_probability(own: Column, other: Column) -> Column:
    """Logistic of the score gap; a gap past the double range gives 0 or 1."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(other - own))


def clamp_max(x: Column, cap: float) -> Column:
    """Upper clamp that keeps NaN (plain ``least`` would replace it by the cap)."""
    return F.when(F.isnan(x), x).otherwise(F.least(x, F.lit(float(cap))))


def strip(x: Column) -> Column:
    """Cut all white space at both ends, not only spaces."""
    return F.regexp_replace(x, _STRIP_PATTERN, "")


def text_from(x: Column, start: Column) -> Column:
    """Characters of ``x`` after the first ``start`` ones."""
    return F.substring(x, start + F.lit(1), F.length(x))


def quotient(x: Column, n: int) -> Column:
    """Integer division that stays in longs."""
    return F.call_function("div", x, F.lit(n))


def take_first(items: Column, n: Column | int) -> Column:
    """``items[:n]`` for n >= 0."""
    return F.slice(items, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def take_last(items: Column, n: int) -> Column:
    """``items[-n:]`` for n > 0; shorter arrays stay whole."""
    return F.slice(items, F.greatest(F.size(items) - F.lit(n) + F.lit(1), F.lit(1)), F.lit(n))


def drop_first(items: Column, n: Column) -> Column:
    """``items[n:]`` for n >= 0."""
    return F.slice(items, n + F.lit(1), F.size(items))


def drop_last(items: Column) -> Column:
    """``items[:-1]``; an empty array stays empty."""
    return F.slice(items, F.lit(1), F.greatest(F.size(items) - F.lit(1), F.lit(0)))


def array_total(items: Column) -> Column:
    """Left-to-right sum of an array of doubles without its nulls."""
    return F.aggregate(items, F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0)))


def hash_order(seed: int, *keys: str) -> Column:
    """Repeatable pseudo-random text to order rows by."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
