"""Three-valued-logic rules of the audit and feature code, as column expressions.

A rule expression is true where a row *fails*. Two families exist:

* negated tests (``not between``, ``not in``, ``not close``, ``differs``): a null operand is a
  failure (N1);
* direct tests (``x <= 0``, ``x < 0``): a null operand is not a failure (N2).
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fails(cond: Column) -> Column:
    """A direct test; null is not a failure."""
    return F.coalesce(cond, F.lit(False))


def fails_between(c: str | Column, lo, hi) -> Column:
    """Outside [lo, hi] or null."""
    return ~F.coalesce(col(c).between(lo, hi), F.lit(False))


def fails_isin(c: str | Column, values: Iterable) -> Column:
    """Not in the set, or null."""
    return ~F.coalesce(col(c).isin(list(values)), F.lit(False))


def differs(a: str | Column, b: str | Column) -> Column:
    """N1 for pandas ``ne``: true when values differ or either side is null (null != null)."""
    return F.coalesce(col(a) != col(b), F.lit(True))


def differs_null_safe(a: str | Column, b: str | Column) -> Column:
    """N3 negated: equal or both null counts as the same value."""
    return ~col(a).eqNullSafe(col(b))


def not_close(a: str | Column, b: str | Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """X14 negated with N1: |a-b| > atol + rtol*|b|, or either side null."""
    a, b = col(a), col(b)
    return ~F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))


def any_of(conds: Iterable[Column]) -> Column:
    """Row-wise any over boolean columns (each already null-resolved)."""
    return reduce(or_, list(conds))


def all_of(conds: Iterable[Column]) -> Column:
    return reduce(and_, list(conds))


def any_null(cols: Iterable[str | Column]) -> Column:
    return any_of(col(c).isNull() for c in cols)


def all_null(cols: Iterable[str | Column]) -> Column:
    return all_of(col(c).isNull() for c in cols)


def all_present(cols: Iterable[str | Column]) -> Column:
    return all_of(col(c).isNotNull() for c in cols)
