"""Column expressions shared by the panel operators."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def rounded(x: Column | str, places: int = 6) -> Column:
    """Round half up on the binary value: the same operations in any engine give the same result."""
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / F.lit(scale)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return a / F.nullif(b, F.lit(0.0))


def trailing(n: int, by: str = "entity", order: str = "date") -> WindowSpec:
    """The last ``n`` rows of an entity, the current one included."""
    return Window.partitionBy(by).orderBy(order).rowsBetween(1 - n, 0)


def rolling(aggregate: Column, window: WindowSpec, least: int, of: Column | None = None) -> Column:
    """``aggregate`` over ``window`` where it holds ``least`` non-null values of ``of`` (rows, if not given)."""
    held = F.count(F.lit(1) if of is None else of).over(window)
    return F.when(held >= least, aggregate.over(window))


def wide(key: str, value: Column, keys: list, name: str) -> list[Column]:
    """One conditional aggregate for each key: a pivot to a known list of columns in a single pass."""
    return [F.max(F.when(F.col(key) == k, value)).alias(name.format(k)) for k in keys]


def half_width(coef: Column, t: Column, z: float = 1.96) -> Column:
    """Half the width of a coefficient's interval, from its t."""
    return z * F.abs(coef) / F.abs(F.nullif(t, F.lit(0.0)))
