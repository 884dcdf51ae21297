"""Weighted Monte-Carlo estimators: plain aggregates, which combine map-side and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Parameters that are sent to every task; more are joined.
BROADCAST = 1_000_000


def five_sums(r: Column, e: Column, m: Column | None = None) -> list[Column]:
    """n, sum r, sum r^2, sum e r, sum e r^2, sum e^2 r^2, each sample counted m times."""
    k = F.lit(1) if m is None else m
    return [F.sum(k).alias("n"), F.sum(k * r).alias("r"), F.sum(k * r * r).alias("rr"), F.sum(k * e * r).alias("er"), F.sum(k * e * r * r).alias("err"), F.sum(k * e * e * r * r).alias("eerr")]


def mean_and_deviation() -> list[Column]:
    """`expect` and `dev` from the five sums; both 0 where all weights are, and no negative variance."""
    r, e = F.col("r"), F.try_divide("er", "r")
    spread = F.col("eerr") - 2 * F.col("err") * e + F.col("rr") * e * e
    return [F.coalesce(e, F.lit(0.0)).alias("expect"), F.coalesce(F.sqrt(F.greatest(F.try_divide(spread, r * r), F.lit(0.0))), F.lit(0.0)).alias("dev")]


def observe(samples: DataFrame, by: list[str], r: Column, e: Column, m: Column | None = None) -> DataFrame:
    """Expectation and its deviation for each group, from weights r and values e."""
    return samples.groupBy(*by).agg(*five_sums(r, e, m)).select(*by, *mean_and_deviation())


def instability(samples: DataFrame, by: list[str], r: Column) -> DataFrame:
    """Population deviation of the weights over their mean; samples of weight zero count."""
    return samples.groupBy(*by).agg(F.try_divide(F.stddev_pop(r), F.avg(r)).alias("v"))


def gradient(samples: DataFrame, by: list[str], r: Column, e: Column, d: Column) -> DataFrame:
    """2 (<e d> - <e><d>) under weights r, for each parameter."""
    sums = samples.groupBy(*by).agg(F.sum(r).alias("r"), F.sum(r * e).alias("re"), F.sum(r * d).alias("rd"), F.sum(r * e * d).alias("red"))
    return sums.select(*by, (2 * (F.col("red") / F.col("r") - F.col("re") / F.col("r") * F.col("rd") / F.col("r"))).alias("g"))


def multiplicity(samples: DataFrame, configuration: list[str]) -> DataFrame:
    return samples.groupBy(*configuration).agg(F.count("*").alias("m"))


def normalisation(samples: DataFrame, by: list[str], amplitude: Column, sites: int) -> DataFrame:
    """exp(mean log |amplitude| / sites), by which each site's tensor is divided."""
    return samples.groupBy(*by).agg(F.exp(F.avg(F.log(F.abs(amplitude))) / sites).alias("param"))


def accepted(ratio: Column, u: Column, power: float = 2.0) -> Column:
    """Metropolis: 1 where u < ratio^power; 0 where there's nothing to compare with."""
    return F.when(ratio.isNotNull() & (u < F.pow(ratio, power)), F.lit(1)).otherwise(F.lit(0))


def conjugate_gradient(deltas: DataFrame, sample: str, parameter: str, delta: str, target: str, steps: int, error: float = 0.0, shift: float = 0.0, means: dict[int, float] | None = None) -> dict[int, float]:
    """x with (D^T D - m m^T + shift) x = D^T e, matrix-free: deltas is long, (sample, parameter, delta), with the sample's
    target e in each of its rows. Weighted deltas and their `means` m give centred deltas' products without a row for the
    zeros. Vectors over parameters are on the driver, those over samples never are."""
    from pyspark.sql import functions as F  # noqa: F811

    spark = deltas.sparkSession

    def transposed(rows: DataFrame, value: str) -> dict[int, float]:
        return {r[parameter]: r["s"] for r in rows.groupBy(parameter).agg(F.sum(F.col(delta) * F.col(value)).alias("s")).collect()}

    def product(x: dict[int, float]) -> dict[int, float]:
        table = spark.createDataFrame(list(x.items()), f"{parameter} long, x double")
        table = F.broadcast(table) if len(x) <= BROADCAST else table
        along = deltas.join(table, parameter).groupBy(sample).agg(F.sum(F.col(delta) * F.col("x")).alias("dx"))
        common = sum(m * x.get(k, 0.0) for k, m in means.items()) if means else 0.0
        return {k: v + shift * x[k] - (means[k] * common if means else 0.0) for k, v in transposed(deltas.join(along, sample), "dx").items()}

    b = transposed(deltas, target)
    x, r, p = dict.fromkeys(b, 0.0), dict(b), dict(b)
    rr = first = sum(v * v for v in r.values())
    for _ in range(steps):
        if rr <= error * error * first or rr == 0:
            break
        q = product(p)
        alpha = rr / sum(p[k] * q[k] for k in p)
        x = {k: x[k] + alpha * p[k] for k in x}
        r = {k: r[k] - alpha * q[k] for k in r}
        new = sum(v * v for v in r.values())
        p = {k: r[k] + new / rr * p[k] for k in p}
        rr = new
    return x
