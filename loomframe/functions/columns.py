"""Column expressions over edges: positions, parities and fermion signs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .symmetry import Edge, Symmetry


def position(edge: Edge, index: Column) -> Column:
    """Number of the segment that an index lies in."""
    out = F.lit(0)
    for p, start in list(enumerate(edge.starts))[1:]:
        out = F.when(index >= start, F.lit(p)).otherwise(out)
    return out


def of_segment(values: Sequence[int], place: Column) -> Column:
    """The value of a segment by its number."""
    if len(set(values)) == 1:
        return F.lit(values[0]).cast("long")
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), place + 1)


def parity(edge: Edge, symmetry: Symmetry, index: Column) -> Column:
    return of_segment([symmetry.parity(q) for q, _ in edge.segments], position(edge, index)).cast("int")


def charge(edge: Edge, component: int, index: Column) -> Column:
    return of_segment([q[component] for q, _ in edge.segments], position(edge, index))


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def permuted(before: Sequence[str], after: Sequence[str], p: dict[str, Column]) -> Column:
    """Pairs of odd edges whose order changes."""
    at = {n: i for i, n in enumerate(after)}
    out = [p[a] * p[b] for i, a in enumerate(before) for b in before[i + 1 :] if at[a] > at[b]]
    return total(out)


def folded(p: Sequence[Column]) -> Column:
    """k * (k - 1) / 2 for k odd edges, as a count of pairs."""
    return total([a * b for i, a in enumerate(p) for b in p[i + 1 :]])


def signed(exponent: Column, value: Column) -> Column:
    return F.when(exponent % 2 == 1, -value).otherwise(value)


def cmul(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def cdiv(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """a / b; where b is zero, each component over zero, as reals have it."""
    size = b[0] * b[0] + b[1] * b[1]
    top = cmul(a, (b[0], -b[1]))
    return tuple(F.when(size != 0, x / size).otherwise(over_zero(y)) for x, y in zip(top, a))


def over_zero(x: Column) -> Column:
    return F.when(x == 0, F.lit(float("nan"))).otherwise(F.signum(x) * float("inf"))


def quotient(x: Column, y: Column) -> Column:
    return F.when(y != 0, x / y).otherwise(over_zero(x))


def soft_inverse(x: Column, r: float, a: float, largest: float) -> Column:
    """1 / (x * (1 + (cut / x) ** 6)), 0 where x <= 0."""
    cut = r * largest + a
    return F.when(x <= 0, F.lit(0.0)).otherwise(1.0 / (x * (1.0 + F.pow(F.lit(cut) / x, 6))))


def safe_reciprocal(x: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(1.0), x))
