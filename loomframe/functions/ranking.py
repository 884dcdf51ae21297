"""Ranks, running sums and draws: the window logic of truncation, merged edges and samplers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truncated(values: DataFrame, charge: str, value: str, order: list[str], remain: int = -1, relative: float = 0.0) -> DataFrame:
    """The largest values over all charges: at most `remain`, above `relative` times the largest, and above zero; of equal
    ones the first in `order`. `remain` < 1 sets no number. With a number the top rows are found without one sort of all
    rows in one task."""
    top = values.agg(F.max(value).alias("_top"))
    out = values.crossJoin(F.broadcast(top)).filter((F.col(value) > relative * F.col("_top")) & (F.col(value) > 0)).drop("_top")
    return out.orderBy(F.col(value).desc(), *order).limit(remain) if remain >= 1 else out


def parse_cut(cut: float) -> tuple[int, float]:
    """(remain, relative) from one number: none up to 0, relative below 1, else a count."""
    return (-1, 0.0) if cut <= 0 else (-1, float(cut)) if cut < 1 else (int(cut), 0.0)


def segment_offsets(segments: DataFrame, charge: str, size: str, order: list[str]) -> DataFrame:
    """`off`: the sizes of one charge's earlier segments, for edges merged in order."""
    w = Window.partitionBy(charge).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("off", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def first_indices(segments: DataFrame, size: str, order: list[str]) -> DataFrame:
    """`first_index` of each segment of one edge; an edge's segments are schema, so one task holds them."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("first_index", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def categorical(weights: DataFrame, group: list[str], index: str, weight: Column, u: Column) -> DataFrame:
    """The first index at which the running weight exceeds u times the total; the last where rounding leaves none."""
    by = Window.partitionBy(*group)
    run = F.sum(weight).over(by.orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = weights.select(*group, F.col(index), run.alias("_run"), F.sum(weight).over(by).alias("_all"), u.alias("_u"))
    return rows.groupBy(*group).agg(F.coalesce(F.min(F.when(F.col("_run") > F.col("_u") * F.col("_all"), F.col(index))), F.max(index)).cast("long").alias("pick"))


def odometer(index: Column, radices: list[int]) -> list[Column]:
    """Digits of a mixed-radix counter whose first digit runs fastest."""
    out, below = [], 1
    for r in radices:
        out.append((F.floor(index / below) % r).cast("int"))
        below *= r
    return out


def differences(before: Column, after: Column) -> Column:
    """(place, old, new) of each state in which two configurations differ."""
    pairs = F.transform(F.arrays_zip(before.alias("old"), after.alias("new")), lambda p, i: F.struct(i.alias("place"), p["old"].alias("old"), p["new"].alias("new")))
    return F.filter(pairs, lambda p: p["old"] != p["new"])


def replaced(configuration: Column, changes: Column) -> Column:
    """The configuration with the given (place, old, new) states put in."""
    return F.aggregate(changes, configuration, lambda c, p: F.transform(c, lambda x, i: F.when(i == p["place"], p["new"]).otherwise(x)))


def uniform(seed: int, low: float = 0.0, high: float = 1.0) -> Callable[[Column], Column]:
    """A draw that depends on the key and the seed alone."""
    return lambda key: (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53) * (high - low) + low


def normal(seed: int, mean: float = 0.0, deviation: float = 1.0) -> Callable[[Column], Column]:
    a, b = uniform(2 * seed), uniform(2 * seed + 1)
    return lambda key: F.sqrt(-2 * F.log(a(key))) * F.cos(b(key) * 6.283185307179586) * deviation + mean
