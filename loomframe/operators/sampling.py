"""Sampling lattices: samples and observations are made in Arrow batches by chain, everything after is aggregation.

A step sends the site tensors, which are the model's parameters, to the tasks; each task row is a chain with a seed of its
own, so results don't depend on partitions. Observations come back as rows and only sums by parameter reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import drop_stored, stored
from . import estimators, peps
from .lattice import State

SAMPLES = "sample_id long, chain_id long, possibility double, ws double, r double, e double, c array<int>, parameter array<long>, delta array<double>"

COLUMNS = ["sample_id", "chain_id", "possibility", "ws", "r", "e", "c", "parameter", "delta"]


@dataclass
class SamplingLattice:
    state: State
    tensors: peps.Tensors
    cut: int = 16
    history: list[tuple[float, float]] = field(default_factory=list)

    @classmethod
    def create(cls, state: State, dimension: int, cut: int = 16, seed: int = 0) -> SamplingLattice:
        state.check_simple()
        tensors = {}
        for a, b in state.sites():
            shape = [1 if b == 0 else dimension, 1 if a == 0 else dimension, 1 if b == state.l2 - 1 else dimension, 1 if a == state.l1 - 1 else dimension, state.dimensions[a, b, 0]]
            tensors[a, b] = np.random.default_rng([seed, a, b]).normal(size=shape)
        return cls(state, tensors, cut)

    @property
    def shape(self) -> peps.Site:
        return self.state.l1, self.state.l2

    def elements(self) -> list[peps.Element]:
        self.state.check_simple()
        out = []
        for key, m in sorted(self.state.terms.items()):
            dims, moves = [self.state.dimensions[p] for p in key], {}
            for y, x in zip(*np.nonzero(m)):
                moves.setdefault(tuple(int(i) for i in np.unravel_index(x, dims)), []).append((tuple(int(i) for i in np.unravel_index(y, dims)), float(m[y, x].real)))
            out.append(([p[:2] for p in key], moves))
        return out

    def offsets(self) -> dict[peps.Site, int]:
        out, at = {}, 0
        for s in sorted(self.tensors):
            out[s] = at
            at += self.tensors[s].size
        return out

    def _look(self, deltas: bool) -> Callable[[peps.Tensors, float, dict[peps.Site, int]], tuple]:
        """What a sample shows: ws, r, e, c, parameter, delta."""
        shape, cut, elements, offsets, sites = self.shape, self.cut, self.elements(), self.offsets(), sorted(self.tensors)

        def look(tensors: peps.Tensors, p: float, c: dict[peps.Site, int]) -> tuple:
            ws = peps.amplitude(tensors, shape, c, cut)
            parameter, delta, e = [], [], 0.0
            if ws != 0:
                e = peps.local_energy(tensors, shape, elements, c, ws, cut)
                if deltas:
                    for s, h in peps.holes(tensors, shape, c, cut).items():
                        at = np.flatnonzero(h)
                        parameter += (at + offsets[s]).tolist()
                        delta += (h.ravel()[at] / ws).tolist()
            return ws, ws * ws / p, e, [c[s] for s in sites], parameter, delta

        return look

    def observe_again(self, spark: SparkSession, samples: DataFrame, deltas: bool = True) -> DataFrame:
        """The configurations of `samples`, drawn as they were, seen with the tensors of now."""
        look, sites = self._look(deltas), sorted(self.tensors)
        shared = spark.sparkContext.broadcast(self.tensors)  # the model's parameters

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(i, k, p, *look(shared.value, p, dict(zip(sites, map(int, c))))) for i, k, p, c in zip(b["sample_id"], b["chain_id"], b["possibility"], b["c"])]
                yield pd.DataFrame(rows, columns=COLUMNS)

        return stored(samples.select("sample_id", "chain_id", "possibility", "c").mapInPandas(run, SAMPLES), "samples")

    def observe(self, spark: SparkSession, method: str, chains: int, steps: int, seed: int = 0, deltas: bool = True, start: Callable[[int], dict[peps.Site, int]] | None = None, restrict: Callable[[dict[peps.Site, int]], bool] | None = None, alpha: float = 1.0, equilibrate: int = 0) -> DataFrame:
        """SAMPLES rows by `sweep`, `direct` or `ergodic` sampling; with `ergodic` chains share all configurations. A
        sample of amplitude zero has weight zero and counts. Sweeping chains take `equilibrate` steps before the first."""
        shape, cut, elements, look = self.shape, self.cut, self.elements(), self._look(deltas)
        sites = sorted(self.tensors)
        dims = [self.tensors[s].shape[4] for s in sites]
        every = int(np.prod(dims))
        shared = spark.sparkContext.broadcast(self.tensors)  # the model's parameters

        def sampled(chain: int) -> Iterator[tuple[float, dict[peps.Site, int]]]:
            tensors, rng = shared.value, np.random.default_rng([seed, chain])
            if method == "ergodic":
                for n in range(chain, every, chains):
                    c = {}
                    for s, d in zip(sites, dims):
                        n, c[s] = divmod(n, d)
                    if restrict is None or restrict(c):
                        yield 1.0, c
            elif method == "direct":
                sampler = peps.DirectSampler(tensors, shape, cut, alpha)
                for _ in range(steps):
                    for _ in range(peps.TRIES):
                        p, c = sampler.draw(rng)
                        if restrict is None or restrict(c):
                            yield p, c
                            break
                    else:
                        raise ValueError(f"the restriction admits none of {peps.TRIES} samples")
            elif method == "sweep":
                c = start(chain) if start else {s: int(rng.integers(d)) for s, d in zip(sites, dims)}
                for _ in range(equilibrate):
                    c, _ = peps.sweep(tensors, shape, elements, c, cut, rng, restrict)
                for _ in range(steps):
                    c, ws = peps.sweep(tensors, shape, elements, c, cut, rng, restrict)
                    yield max(ws * ws, 1e-300), c
            else:
                raise ValueError(f"no sampling named {method}")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tensors = shared.value
            for batch in batches:
                for chain in batch["id"].tolist():
                    rows = []
                    for n, (p, c) in enumerate(sampled(chain)):
                        rows.append((chain * (1 << 32) + n, chain, p, *look(tensors, p, c)))
                    yield pd.DataFrame(rows, columns=COLUMNS)

        return stored(spark.range(chains).repartition(min(chains, 64), "id").mapInPandas(run, SAMPLES), "samples")

    def energy(self, samples: DataFrame) -> tuple[float, float]:
        """Energy per site and its deviation."""
        r = estimators.observe(samples.withColumn("g", F.lit(1)), ["g"], F.col("r"), F.col("e")).first()
        return r["expect"] / self.state.site_number, r["dev"] / self.state.site_number

    def _totals(self, samples: DataFrame) -> tuple[float, float]:
        t = samples.agg(F.sum("r").alias("r"), F.sum(F.col("r") * F.col("e")).alias("re")).first()
        return t["r"], t["re"] / t["r"]

    def gradient(self, samples: DataFrame) -> np.ndarray:
        """2 (<e d> - <e><d>) by parameter, a delta without a row being zero."""
        total, mean = self._totals(samples)
        long = samples.select("r", "e", F.explode(F.arrays_zip("parameter", "delta")).alias("z")).select("r", "e", "z.parameter", "z.delta")
        sums = long.groupBy("parameter").agg(F.sum(F.col("r") * F.col("delta")).alias("rd"), F.sum(F.col("r") * F.col("e") * F.col("delta")).alias("red"))
        out = np.zeros(sum(t.size for t in self.tensors.values()))
        for r in sums.collect():  # one row a parameter of the model
            out[r["parameter"]] = 2 * (r["red"] - mean * r["rd"]) / total
        return out

    def natural_gradient(self, samples: DataFrame, steps: int = 20, shift: float = 1e-3) -> np.ndarray:
        """The gradient in the metric of the centred deltas, by conjugate gradients without a matrix over samples."""
        total, mean = self._totals(samples)
        n = sum(t.size for t in self.tensors.values())
        long = samples.select("sample_id", "r", "e", F.explode(F.arrays_zip("parameter", "delta")).alias("z")).select("sample_id", "r", "e", "z.parameter", "z.delta")
        means = {r["parameter"]: r["m"] for r in long.groupBy("parameter").agg((F.sum(F.col("r") * F.col("delta")) / total).alias("m")).collect()}
        root = F.sqrt(F.col("r") / total)
        rows = stored(long.select("sample_id", "parameter", (root * F.col("delta")).alias("delta"), (root * (F.col("e") - mean)).alias("t")), "deltas")
        x = estimators.conjugate_gradient(rows, "sample_id", "parameter", "delta", "t", steps, 1e-6, shift, means)
        drop_stored(rows)
        return np.array([2 * x.get(i, 0.0) for i in range(n)])

    def apply(self, change: np.ndarray) -> None:
        for s, at in self.offsets().items():
            self.tensors[s] = self.tensors[s] - change[at : at + self.tensors[s].size].reshape(self.tensors[s].shape)

    def norm(self) -> float:
        return float(np.sqrt(sum((t**2).sum() for t in self.tensors.values())))

    def normalise(self, samples: DataFrame) -> None:
        """Divides every site by exp(mean log |ws| / sites)."""
        p = estimators.normalisation(samples.filter("ws <> 0").withColumn("g", F.lit(1)), ["g"], F.col("ws"), self.state.site_number).first()["param"]
        self.tensors = {s: t / p for s, t in self.tensors.items()}

    def descend(self, spark: SparkSession, steps: int, rate: float, method: str = "sweep", chains: int = 4, samples: int = 50, seed: int = 0, relative: bool = False, momentum: float = 0.0, natural: bool = False, random: bool = False, search: bool = False, stop: Callable[[], bool] | None = None, **options) -> Iterator[tuple[float, float]]:
        """Gradient steps; yields energy per site and deviation before each. `relative` scales a step to the tensors'
        norm, `momentum` adds the last direction, `random` keeps the gradient's signs alone, each times a draw from 0 to 1,
        `search` seeks each step's rate on its own samples. Ends early once `stop` says so."""
        last = np.zeros(sum(t.size for t in self.tensors.values()))
        for step in range(steps):
            if stop is not None and stop():
                return
            rows = self.observe(spark, method, chains, samples, seed + 7919 * step, **options)
            self.history.append(self.energy(rows))
            yield self.history[-1]
            change = self.natural_gradient(rows) if natural else self.gradient(rows)
            if random:
                change = np.sign(change) * np.random.default_rng([seed, step]).random(len(change))
            last = change + momentum * last
            size = np.linalg.norm(last)
            scale = rate * self.norm() / size if relative and size else rate
            self.apply(last * (self.line_search(rows, last, scale) if search else scale))
            self.normalise(rows)
            drop_stored(rows)

    def line_search(self, samples: DataFrame, gradient: np.ndarray, rate: float, trial: Callable[[], DataFrame] | None = None, most: int = 8) -> float:
        """A rate at which the gradient at the trial point, seen on samples of `trial` or else on `samples`, still points
        along `gradient`."""
        keep = dict(self.tensors)
        for _ in range(most):
            self.tensors = dict(keep)
            self.apply(gradient * rate)
            seen = trial() if trial else self.observe_again(samples.sparkSession, samples)
            along = float(self.gradient(seen) @ gradient)
            if trial is None:
                drop_stored(seen)
            if along >= 0:
                break
            rate /= 2
        self.tensors = keep
        return rate


def finite_differences(spark: SparkSession, lattice: SamplingLattice, parameters: list[int], step: float = 1e-4, chains: int = 4) -> dict[int, float]:
    """Derivatives of the exact energy by some parameters, from two energies each; to check gradients with."""
    offsets = lattice.offsets()

    def energy(parameter: int, shift: float) -> float:
        site = max((s for s in offsets if offsets[s] <= parameter), key=lambda s: offsets[s])
        tensors = {s: t.copy() for s, t in lattice.tensors.items()}
        tensors[site].ravel()[parameter - offsets[site]] += shift
        rows = SamplingLattice(lattice.state, tensors, lattice.cut).observe(spark, "ergodic", chains, 0, deltas=False).withColumn("g", F.lit(0))
        return estimators.observe(rows, ["g"], F.col("r"), F.col("e")).first()["expect"]

    return {p: (energy(p, step) - energy(p, -step)) / (2 * step) for p in parameters}
