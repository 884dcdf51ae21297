"""Neural states: a network gives the amplitudes of whole batches of configurations.

Networks are plain arrays and numpy; a batch of configurations is an integer matrix, a row each, with columns in the order of
the state's points. The parameters, which are the model, are sent to the tasks; configurations, amplitudes and derivatives
stay there, and sums by parameter alone reach the driver, as with sampling lattices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import stored
from . import estimators
from .lattice import State
from .sampling import SAMPLES, SamplingLattice

#: Configurations that a network sees at once.
BLOCK = 2048
#: Values in a row of a file of weights.
PART = 1_000_000

Restriction = Callable[[np.ndarray], np.ndarray]


class Network:
    """Real amplitudes of configurations, and their logarithmic derivatives by each parameter."""

    def __init__(self, state: State, parameters: dict[str, np.ndarray]):
        self.dims = [state.dimensions[p] for p in state.points]
        self.parameters = parameters

    def amplitude(self, c: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def by_parameter(self, c: np.ndarray, ws: np.ndarray) -> dict[str, np.ndarray]:
        """d ws / d parameter / ws for amplitudes that aren't zero, with the batch as first axis."""
        raise NotImplementedError

    def generate(self, count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Distinct configurations of `count` draws from the squared amplitudes, and how often each was drawn."""
        raise NotImplementedError(f"{type(self).__name__} has no direct sampling")

    def blocks(self, c: np.ndarray) -> np.ndarray:
        return np.concatenate([self.amplitude(c[i : i + BLOCK]) for i in range(0, len(c), BLOCK)]) if len(c) else np.zeros(0)

    def deltas(self, c: np.ndarray, ws: np.ndarray) -> np.ndarray:
        own = self.by_parameter(c, ws)
        return np.concatenate([own[n].reshape(len(c), -1) for n in sorted(own)], axis=1)


class Table(Network):
    """One parameter a configuration."""

    def __init__(self, state: State, seed: int = 0):
        super().__init__(state, {})
        self.parameters["table"] = np.random.default_rng(seed).normal(size=int(np.prod(self.dims)))

    def _index(self, c: np.ndarray) -> np.ndarray:
        return np.ravel_multi_index(tuple(c.T), self.dims)

    def amplitude(self, c: np.ndarray) -> np.ndarray:
        return self.parameters["table"][self._index(c)]

    def by_parameter(self, c: np.ndarray, ws: np.ndarray) -> dict[str, np.ndarray]:
        out = np.zeros((len(c), self.parameters["table"].size))
        out[np.arange(len(c)), self._index(c)] = 1 / ws
        return {"table": out}


class Chain(Network):
    """A product of matrices, one a point, chosen by the point's state, between vectors of ones."""

    def __init__(self, state: State, bond: int = 4, seed: int = 0):
        super().__init__(state, {})
        rng = np.random.default_rng(seed)
        self.parameters["matrices"] = rng.normal(size=(len(self.dims), max(self.dims), bond, bond)) / np.sqrt(bond)

    def _lines(self, c: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Products left and right of each point."""
        m = self.parameters["matrices"]
        left = [np.ones((len(c), m.shape[2]))]
        right = [np.ones((len(c), m.shape[2]))]
        for i in range(len(m) - 1):
            left.append(np.einsum("ba,bac->bc", left[-1], m[i, c[:, i]]))
            right.append(np.einsum("bac,bc->ba", m[-1 - i, c[:, -1 - i]], right[-1]))
        return left, right[::-1]

    def amplitude(self, c: np.ndarray) -> np.ndarray:
        m = self.parameters["matrices"]
        line = np.ones((len(c), m.shape[2]))
        for i in range(len(m)):
            line = np.einsum("ba,bac->bc", line, m[i, c[:, i]])
        return line.sum(axis=1)

    def by_parameter(self, c: np.ndarray, ws: np.ndarray) -> dict[str, np.ndarray]:
        left, right = self._lines(c)
        out = np.zeros((len(c), *self.parameters["matrices"].shape))
        for i, (a, b) in enumerate(zip(left, right)):
            out[np.arange(len(c)), i, c[:, i]] = a[:, :, None] * b[:, None, :] / ws[:, None, None]
        return {"matrices": out}


class Convolution(Network):
    """Filters over the periodic lattice, log cosh of what they see, summed over places: positive amplitudes that don't
    change under translations. `staggered` gives each state above zero on every other site a minus."""

    def __init__(self, state: State, channels: int = 4, width: int = 3, staggered: bool = False, seed: int = 0):
        super().__init__(state, {})
        if len(self.dims) % state.site_number:
            raise ValueError("every site needs the same number of orbits")
        self.grid = (state.l1, state.l2, len(self.dims) // state.site_number)
        self.signs = np.array([sum(p[:2]) % 2 for p in state.points]) if staggered else None
        rng = np.random.default_rng(seed)
        self.parameters |= {"filters": 0.1 * rng.normal(size=(channels, width, width, self.grid[2])), "bias": 0.1 * rng.normal(size=channels), "weight": 0.1 * rng.normal(size=channels)}

    def _seen(self, c: np.ndarray) -> np.ndarray:
        """(batch, place, row, column, orbit): the centred states around each place."""
        s = (c - (np.array(self.dims) - 1) / 2).reshape(-1, *self.grid)
        width = self.parameters["filters"].shape[1]
        parts = [np.roll(s, (-i, -j), axis=(1, 2)) for i in range(width) for j in range(width)]
        return np.stack(parts, axis=3).reshape(len(c), self.grid[0] * self.grid[1], width, width, self.grid[2])

    def _hidden(self, seen: np.ndarray) -> np.ndarray:
        return np.einsum("bxijo,kijo->bxk", seen, self.parameters["filters"]) + self.parameters["bias"]

    def amplitude(self, c: np.ndarray) -> np.ndarray:
        h = self._hidden(self._seen(c))
        out = np.exp((np.logaddexp(h, -h) - np.log(2)).sum(axis=1) @ self.parameters["weight"])
        return out if self.signs is None else out * (1 - 2 * ((c > 0) @ self.signs % 2))

    def by_parameter(self, c: np.ndarray, ws: np.ndarray) -> dict[str, np.ndarray]:
        seen = self._seen(c)
        h = self._hidden(seen)
        slope = np.tanh(h) * self.parameters["weight"]
        return {"filters": np.einsum("bxk,bxijo->bkijo", slope, seen), "bias": slope.sum(axis=1), "weight": (np.logaddexp(h, -h) - np.log(2)).sum(axis=1)}


class Autoregressive(Network):
    """A hidden layer a point reads the states of the points before it and gives the point's states real weights, which
    are normalised, so that squared amplitudes add up to one and can be drawn from. With `counts`, a state that was taken
    counts[state] times is masked, so that every configuration has each state just that often."""

    def __init__(self, state: State, hidden: int = 8, counts: list[int] | None = None, seed: int = 0):
        super().__init__(state, {})
        n, d = len(self.dims), max(self.dims)
        if counts is not None and (len(counts) != d or sum(counts) != n or min(self.dims) != d):
            raise ValueError("counts need one number a state that add up to the points")
        self.counts = None if counts is None else np.array(counts)
        rng = np.random.default_rng(seed)
        self.parameters |= {"first": rng.normal(size=(n, n * d, hidden)) / np.sqrt(n), "shift": 0.1 * rng.normal(size=(n, hidden)), "second": 0.3 * rng.normal(size=(n, hidden, d)), "level": 1 + 0.1 * rng.normal(size=(n, d))}

    def _before(self, c: np.ndarray) -> np.ndarray:
        d = max(self.dims)
        return np.eye(d)[c].reshape(len(c), c.shape[1] * d)

    def mask(self, c: np.ndarray, i: int) -> np.ndarray:
        """Which states point i may have after the states of the points before it."""
        d = max(self.dims)
        ok = np.broadcast_to(np.arange(d) < self.dims[i], (len(c), d))
        if self.counts is None:
            return ok
        used = (c[:, :i, None] == np.arange(d)).sum(axis=1)
        return ok & (used < self.counts)

    def _step(self, x: np.ndarray, c: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """What the hidden layer of point i gives, and the weights of its states."""
        p, width = self.parameters, i * max(self.dims)
        h = np.tanh(x[:, :width] @ p["first"][i, :width] + p["shift"][i])
        return h, np.where(self.mask(c, i), h @ p["second"][i] + p["level"][i], 0.0)

    def amplitude(self, c: np.ndarray) -> np.ndarray:
        x, out, rows = self._before(c), np.ones(len(c)), np.arange(len(c))
        for i in range(c.shape[1]):
            _, y = self._step(x, c, i)
            size = np.linalg.norm(y, axis=1)
            out *= np.divide(y[rows, c[:, i]], size, out=np.zeros(len(c)), where=size > 0)
        return out

    def by_parameter(self, c: np.ndarray, ws: np.ndarray) -> dict[str, np.ndarray]:
        x, rows, p = self._before(c), np.arange(len(c)), self.parameters
        out = {n: np.zeros((len(c), *a.shape)) for n, a in p.items()}
        for i in range(c.shape[1]):
            h, y = self._step(x, c, i)
            slope = -y / (y * y).sum(axis=1, keepdims=True)
            slope[rows, c[:, i]] += 1 / y[rows, c[:, i]]
            slope = np.where(self.mask(c, i), slope, 0.0)
            back = (slope @ p["second"][i].T) * (1 - h * h)
            width = i * max(self.dims)
            out["level"][:, i], out["second"][:, i] = slope, h[:, :, None] * slope[:, None, :]
            out["shift"][:, i], out["first"][:, i, :width] = back, x[:, :width, None] * back[:, None, :]
        return out

    def generate(self, count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """The draws are dealt out to the states of one point after another; prefixes that get none are dropped, so work
        follows the distinct configurations."""
        c, times = np.zeros((1, 0), int), np.array([count])
        for i in range(len(self.dims)):
            _, y = self._step(self._before(c), c, i)
            weights = y * y
            dealt = rng.multinomial(times, weights / weights.sum(axis=1, keepdims=True))
            row, new = np.nonzero(dealt)
            c, times = np.column_stack([c[row], new]), dealt[row, new]
        return c, times


NETWORKS: dict[str, Callable[..., Network]] = {"table": Table, "chain": Chain, "convolution": Convolution, "autoregressive": Autoregressive}


def write_weights(spark: SparkSession, network: Network, path: str) -> None:
    rows = [(n, list(a.shape), at, a.ravel()[at : at + PART].tolist()) for n, a in network.parameters.items() for at in range(0, max(a.size, 1), PART)]
    spark.createDataFrame(rows, "name string, shape array<int>, start long, weights array<double>").write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, network: Network, path: str) -> None:
    """Sets the parameters of a network of the same form."""
    new: dict[str, np.ndarray] = {n: np.full(a.size, np.nan) for n, a in network.parameters.items()}
    for r in spark.read.parquet(path).toLocalIterator():  # the model's own parameters, which the driver holds anyway
        if r["name"] not in new or tuple(r["shape"]) != network.parameters[r["name"]].shape:
            raise ValueError(f"the network has no parameter {r['name']} of shape {r['shape']}")
        new[r["name"]][r["start"] : r["start"] + len(r["weights"])] = r["weights"]
    if any(np.isnan(a).any() for a in new.values()):
        raise ValueError("the file lacks parameters of the network")
    network.parameters = {n: a.reshape(network.parameters[n].shape) for n, a in new.items()}


Terms = list[tuple[list[int], list[int], list[tuple[int, int, float]]]]


def local_energies(network: Network, terms: Terms, c: np.ndarray, ws: np.ndarray, restrict: Restriction | None = None) -> np.ndarray:
    """Sum of element * target amplitude / ws of each configuration. Diagonal elements need no amplitude; the others' distinct
    targets go through the network together, and those that `restrict` refuses have none."""
    e = np.zeros(len(c))
    rows, factors, targets = [], [], []
    for where, dims, elements in terms:
        code = np.ravel_multi_index(tuple(c[:, where].T), dims)
        for x, y, v in elements:
            hit = np.flatnonzero(code == x)
            if x == y:
                e[hit] += v
                continue
            new = c[hit]
            new[:, where] = np.unravel_index(y, dims)
            rows.append(hit)
            factors.append(np.full(len(hit), v))
            targets.append(new)
    if targets:
        distinct, place = np.unique(np.concatenate(targets), axis=0, return_inverse=True)
        found = network.blocks(distinct)
        if restrict is not None:
            found = np.where(restrict(distinct), found, 0.0)
        row = np.concatenate(rows)
        np.add.at(e, row, np.concatenate(factors) * found[place.ravel()] / ws[row])
    return e


def sweeps(network: Network, terms: Terms, c: np.ndarray, draws: list[np.random.Generator], restrict: Restriction | None = None) -> Iterator[np.ndarray]:
    """Walkers, a row each with a generator each, after as many proposals as points. A proposal is one of a random term's
    targets, the state itself only where there's no other; all walkers' proposals go through the network together."""
    moves = []
    for where, dims, elements in terms:
        own: dict[int, list[int]] = {}
        for x, y, _ in elements:
            own.setdefault(x, []).append(y)
        moves.append((where, dims, {x: [y for y in ys if y != x] or [x] for x, ys in own.items()}))
    ws = network.blocks(c)
    while True:
        for _ in range(c.shape[1]):
            new, weigh = c.copy(), np.zeros(len(c))
            for k, rng in enumerate(draws):
                where, dims, options = moves[int(rng.integers(len(moves)))]
                old = int(np.ravel_multi_index(tuple(c[k, where]), dims))
                to = options.get(old)
                if to:
                    pick = to[int(rng.integers(len(to)))]
                    new[k, where] = np.unravel_index(pick, dims)
                    weigh[k] = len(to) / len(options.get(pick, to))
            changed = network.blocks(new)
            if restrict is not None:
                changed = np.where(restrict(new), changed, 0.0)
            ratio = np.divide(changed, ws, out=np.where(weigh > 0, np.inf, 0.0), where=ws != 0)
            take = np.array([rng.random() for rng in draws]) < ratio**2 * weigh
            c, ws = np.where(take[:, None], new, c), np.where(take, changed, ws)
        yield c


def looked(network: Network, terms: Terms, ids: np.ndarray, chain: np.ndarray, m: np.ndarray, p: np.ndarray, c: np.ndarray, ws: np.ndarray, deltas: bool, restrict: Restriction | None) -> pd.DataFrame:
    """Rows of samples whose amplitudes aren't zero."""
    e = local_energies(network, terms, c, ws, restrict) if len(c) else np.zeros(0)
    parameter, delta = [[]] * len(c), [[]] * len(c)
    if deltas and len(c):
        every = network.deltas(c, ws)
        parameter = [np.flatnonzero(row) for row in every]
        delta = [row[at] for row, at in zip(every, parameter)]
    return pd.DataFrame({"sample_id": ids, "chain_id": chain, "possibility": p, "ws": ws, "r": ws * ws / p, "e": e, "c": list(c.astype(np.int32)), "parameter": parameter, "delta": delta, "m": m})


class NeuralState(SamplingLattice):
    """Sampling, observation and descent with a network in place of site tensors. Samples have a multiplicity `m`, with
    which each counts."""

    def __init__(self, state: State, network: Network):
        self.state, self.network, self.cut, self.history = state, network, 0, []

    @classmethod
    def create(cls, state: State, network: str = "table", **options) -> NeuralState:
        return cls(state, NETWORKS[network](state, **options))

    @property
    def tensors(self) -> dict[str, np.ndarray]:
        return self.network.parameters

    @tensors.setter
    def tensors(self, value: dict[str, np.ndarray]) -> None:
        self.network.parameters = value

    def terms(self) -> Terms:
        if any(np.abs(np.imag(m)).max() > 0 for m in self.state.terms.values()):
            raise NotImplementedError("neural states are real, and a term is complex; use an exact state")
        place = {p: i for i, p in enumerate(self.state.points)}
        return [([place[p] for p in key], [self.state.dimensions[p] for p in key], [(int(x), int(y), float(m[y, x].real)) for y, x in zip(*np.nonzero(m))]) for key, m in sorted(self.state.terms.items())]

    def observe(self, spark: SparkSession, method: str, chains: int, steps: int, seed: int = 0, deltas: bool = True, start: Callable[[int], list[int]] | None = None, restrict: Restriction | None = None, equilibrate: int = 0) -> DataFrame:
        """SAMPLES rows and `m`: `sweep`, `steps` of each chain; `direct`, the distinct ones of `steps` draws of each chain;
        `ergodic`, every configuration. Configurations of amplitude zero are left out, as are direct draws that `restrict`
        refuses. Chains of an Arrow batch walk together, each with a seed of its own."""
        terms, dims = self.terms(), self.network.dims
        every = int(np.prod(dims, dtype=object))
        shared = spark.sparkContext.broadcast(self.network)  # the model's parameters

        def sampled(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            """Chains, numbers in them, multiplicities, configurations."""
            network = shared.value
            if method == "sweep":
                draws = [np.random.default_rng([seed, k]) for k in ids.tolist()]
                c = np.array([start(k) for k in ids.tolist()] if start else [[int(rng.integers(d)) for d in dims] for rng in draws])
                walk = sweeps(network, terms, c, draws, restrict)
                for _ in range(equilibrate):
                    next(walk)
                for n in range(steps):
                    yield ids, np.full(len(ids), n), np.ones(len(ids), int), next(walk)
            elif method == "direct":
                for k in ids.tolist():
                    c, m = network.generate(steps, np.random.default_rng([seed, k]))
                    for i in range(0, len(c), BLOCK):
                        part = c[i : i + BLOCK]
                        yield np.full(len(part), k), np.arange(i, i + len(part)), m[i : i + BLOCK], part
            elif method == "ergodic":
                for k in ids.tolist():
                    for first in range(k, every, chains * BLOCK):
                        at = np.arange(first, min(every, first + chains * BLOCK), chains)
                        c = np.column_stack(np.unravel_index(at, dims, order="F"))
                        yield np.full(len(at), k), at // chains, np.ones(len(at), int), c
            else:
                raise ValueError(f"no sampling named {method}")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            network = shared.value
            for batch in batches:
                for chain, number, m, c in sampled(batch["id"].to_numpy()):
                    ws = network.blocks(c)
                    ok = ws != 0
                    if restrict is not None and method != "sweep":
                        ok &= restrict(c)
                    chain, number, m, c, ws = chain[ok], number[ok], m[ok], c[ok], ws[ok]
                    p = np.ones(len(c)) if method == "ergodic" else ws * ws
                    yield looked(network, terms, chain * (1 << 32) + number, chain, m, p, c, ws, deltas, restrict)

        return stored(spark.range(chains).repartition(min(chains, 64), "id").mapInPandas(run, SAMPLES + ", m long"), "samples")

    def observe_again(self, spark: SparkSession, samples: DataFrame, deltas: bool = True, restrict: Restriction | None = None) -> DataFrame:
        terms, shared = self.terms(), spark.sparkContext.broadcast(self.network)  # the model's parameters

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            network = shared.value
            for batch in batches:
                for b in (batch.iloc[i : i + BLOCK] for i in range(0, len(batch), BLOCK)):
                    c = np.array(b["c"].tolist(), int)
                    ws = network.amplitude(c)
                    ok = ws != 0
                    own = (b[n].to_numpy()[ok] for n in ("sample_id", "chain_id", "m", "possibility"))
                    yield looked(network, terms, *own, c[ok], ws[ok], deltas, restrict)

        rows = samples.select("sample_id", "chain_id", "possibility", "c", "m")
        return stored(rows.mapInPandas(run, SAMPLES + ", m long"), "samples")

    def energy(self, samples: DataFrame) -> tuple[float, float]:
        """Energy per site and its deviation."""
        r = estimators.observe(samples.withColumn("g", F.lit(1)), ["g"], F.col("r"), F.col("e"), F.col("m")).first()
        return r["expect"] / self.state.site_number, r["dev"] / self.state.site_number

    @staticmethod
    def _counted(samples: DataFrame) -> DataFrame:
        return samples.withColumn("r", F.col("r") * F.col("m"))

    def gradient(self, samples: DataFrame) -> np.ndarray:
        return super().gradient(self._counted(samples))

    def natural_gradient(self, samples: DataFrame, steps: int = 20, shift: float = 1e-2) -> np.ndarray:
        """`shift` is relative to the mean variance of the deltas."""
        rows = self._counted(samples)
        total, _ = self._totals(rows)
        long = rows.select("r", F.explode(F.arrays_zip("parameter", "delta")).alias("z"))
        sums = long.groupBy("z.parameter").agg(F.sum(F.col("r") * F.col("z.delta")).alias("rd"), F.sum(F.col("r") * F.col("z.delta") * F.col("z.delta")).alias("rdd"))
        spread = sums.agg(F.sum(F.col("rdd") / total - (F.col("rd") / total) ** 2)).first()[0] or 0.0
        return super().natural_gradient(rows, steps, shift * spread / sum(a.size for a in self.tensors.values()))

    def normalise(self, samples: DataFrame) -> None:
        """A network's amplitudes keep their scale, which no expectation depends on."""
