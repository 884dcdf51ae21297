"""Lattices of sites with physical edges, Hamiltonians as term tables, and states over them.

Sites carry one edge per orbit, named P_<l1>_<l2>_<orbit>. A term acts on a list of points (l1, l2, orbit) and is a small
matrix from the points' input states to their output states, both in row-major order.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.symmetry import NO, Edge, Schema
from . import exact
from .tensor import Tensor, col

Point = tuple[int, int, int]

# Spin matrices for spin one half.
SX = np.array([[0, 0.5], [0.5, 0]])
SY = np.array([[0, -0.5j], [0.5j, 0]])
SZ = np.array([[0.5, 0], [0, -0.5]])
SIGMA_X, SIGMA_Y, SIGMA_Z = 2 * SX, 2 * SY, 2 * SZ
UNIT = np.eye(2)


def product(*matrices: np.ndarray) -> np.ndarray:
    out = np.eye(1)
    for m in matrices:
        out = np.kron(out, m)
    return out


#: S . S of two spins, real.
SS = np.real(product(SX, SX) + product(SY, SY) + product(SZ, SZ))


@dataclass
class State:
    """Sites, physical dimensions and Hamiltonian terms; repeated points are contracted, points sorted, equal keys added."""

    l1: int
    l2: int
    dimensions: dict[Point, int] = field(default_factory=dict)
    terms: dict[tuple[Point, ...], np.ndarray] = field(default_factory=dict)

    def sites(self) -> list[tuple[int, int]]:
        return list(itertools.product(range(self.l1), range(self.l2)))

    @property
    def site_number(self) -> int:
        return self.l1 * self.l2

    def set_physics(self, dimension: int, orbits: int = 1) -> None:
        self.dimensions = {(a, b, o): dimension for a, b in self.sites() for o in range(orbits)}

    @property
    def points(self) -> list[Point]:
        return sorted(self.dimensions)

    def add(self, points: Iterable[Point], matrix: np.ndarray) -> None:
        points = tuple(points)
        dims = [self.dimensions[p] for p in points]
        a = np.asarray(matrix).reshape(dims + dims)
        while len(set(points)) < len(points):  # the operator that stands first acts last
            j = next(i for i, p in enumerate(points) if p in points[:i])
            i, n = points.index(points[j]), len(points)
            a = np.trace(np.moveaxis(a, (n + i, j), (-2, -1)), axis1=-2, axis2=-1)
            # Axes now: outputs without j, inputs without i; the input of j takes i's place.
            points = points[:j] + points[j + 1 :]
            m = len(points)
            ins = list(range(m, 2 * m))
            ins.insert(i, ins.pop(j - 1))
            a = np.transpose(a, [*range(m), *ins])
        order = sorted(range(len(points)), key=lambda k: points[k])
        m = len(points)
        a = np.transpose(a, [*order, *(m + k for k in order)])
        key = tuple(points[k] for k in order)
        flat = a.reshape(int(np.prod(a.shape[:m])), -1)
        self.terms[key] = self.terms[key] + flat if key in self.terms else flat
        if not np.abs(self.terms[key]).max() > 0:
            del self.terms[key]

    def set_terms(self, where: str | Iterable[Point], matrix: np.ndarray) -> None:
        """`single_site`, `vertical_bond` and `horizontal_bond` stand for all such points of orbit 0."""
        if where == "single_site":
            for a, b in self.sites():
                self.add([(a, b, 0)], matrix)
        elif where == "vertical_bond":
            for a, b in itertools.product(range(self.l1 - 1), range(self.l2)):
                self.add([(a, b, 0), (a + 1, b, 0)], matrix)
        elif where == "horizontal_bond":
            for a, b in itertools.product(range(self.l1), range(self.l2 - 1)):
                self.add([(a, b, 0), (a, b + 1, 0)], matrix)
        else:
            self.add(where, matrix)

    def check_simple(self) -> None:
        """Site tensors have one physical edge, real numbers and no charge; other models run as exact states only."""
        if any(p[2] for p in self.dimensions):
            raise NotImplementedError("site tensors have one orbit a site; use an exact state")
        if any(np.abs(np.imag(m)).max() > 0 for m in self.terms.values()):
            raise NotImplementedError("site tensors are real, and a term is complex; use an exact state")

    def check_hermite(self, threshold: float = 1e-8) -> None:
        for key, m in self.terms.items():
            if np.abs(m - m.conj().T).max() > threshold:
                raise ValueError(f"the term at {key} isn't hermitian")

    def elements(self, spark: SparkSession) -> DataFrame:
        """(term_id, points, x, y, re, im): each non-zero element as local configurations before and after."""
        rows = []
        for t, (key, m) in enumerate(sorted(self.terms.items())):
            dims = [self.dimensions[p] for p in key]
            for y, x in zip(*np.nonzero(m)):
                v = complex(m[y, x])
                rows.append((t, [list(p) for p in key], [int(i) for i in np.unravel_index(x, dims)], [int(i) for i in np.unravel_index(y, dims)], v.real, v.imag))
        return spark.createDataFrame(rows, "term_id int, points array<array<int>>, x array<int>, y array<int>, re double, im double")

    def matrix(self) -> np.ndarray:
        """The dense Hamiltonian; for small lattices."""
        dims = [self.dimensions[p] for p in self.points]
        n = int(np.prod(dims))
        out = np.zeros((n, n), complex)
        for key, m in self.terms.items():
            own = [self.points.index(p) for p in key]
            rest = [i for i in range(len(dims)) if i not in own]
            a = np.kron(m, np.eye(int(np.prod([dims[i] for i in rest]))))
            order = own + rest
            shape = [dims[i] for i in order]
            back = np.argsort(order)
            a = a.reshape(shape + shape).transpose([*back, *(len(dims) + back)])
            out += a.reshape(n, n)
        return out if np.abs(out.imag).max() > 0 else out.real

    # --- as tensors

    def _name(self, p: Point) -> str:
        return "P_" + "_".join(map(str, p))

    def term_tensor(self, spark: SparkSession, key: tuple[Point, ...]) -> Tensor:
        m, dims = self.terms[key], [self.dimensions[p] for p in key]
        names = [f"O{i}" for i in range(len(key))] + [f"I{i}" for i in range(len(key))]
        rows = [(*map(int, np.unravel_index(y, dims)), *map(int, np.unravel_index(x, dims)), float(m[y, x].real), float(m[y, x].imag)) for y, x in zip(*np.nonzero(m))]
        df = spark.createDataFrame(rows, ", ".join([*(f"{col(n)} long" for n in names), "re double", "im double"]))
        t = Tensor(df, Schema(tuple(names), tuple(map(Edge.plain, dims + dims)), NO, True))
        return t if np.abs(m.imag).max() > 0 else t.to_real()

    def random_vector(self, spark: SparkSession, seed: int = 0) -> Tensor:
        return Tensor.random(spark, [self._name(p) for p in self.points], [self.dimensions[p] for p in self.points], seed=seed)

    def apply_term(self, spark: SparkSession, key: tuple[Point, ...], v: Tensor) -> Tensor:
        t = self.term_tensor(spark, key)
        out = t.contract(v, [(f"I{i}", self._name(p)) for i, p in enumerate(key)])
        return out.edge_rename({f"O{i}": self._name(p) for i, p in enumerate(key)}).transpose(v.names)

    def apply(self, spark: SparkSession, v: Tensor) -> Tensor:
        """H v: one union of all terms' products, summed once."""
        parts = [self.apply_term(spark, key, v) for key in sorted(self.terms)]
        is_complex = any(p.schema.is_complex for p in parts)
        parts = [p.to_complex() if is_complex else p for p in parts]
        df = parts[0].df
        for p in parts[1:]:
            df = df.unionAll(p.df)
        out = Tensor(df, parts[0].schema)
        return Tensor(df.groupBy(*out.keys).agg(*(F.sum(x).alias(x) for x in out.values)), out.schema)

    def ground_state(self, spark: SparkSession, steps: int, seed: int = 0) -> tuple[float, Tensor]:
        """Lowest energy per site and its vector."""
        energy, v = exact.ground_state(lambda x: self.apply(spark, x), self.random_vector(spark, seed), steps)
        return energy / self.site_number, v

    def observe(self, spark: SparkSession, v: Tensor, points: Iterable[Point], matrix: np.ndarray) -> float:
        """<v| O |v> / <v|v>."""
        own = State(self.l1, self.l2, self.dimensions)
        own.add(points, matrix)
        return exact.inner(v, own.apply(spark, v)) / exact.inner(v, v)

    # --- sampling

    def ergodic(self, spark: SparkSession) -> DataFrame:
        """(sample_id, possibility, c): every configuration once, the first point fastest."""
        from ..functions.ranking import odometer

        dims = [self.dimensions[p] for p in self.points]
        n = int(np.prod(dims))
        return spark.range(n).select(F.col("id").alias("sample_id"), F.lit(1.0).alias("possibility"), F.array(*odometer(F.col("id"), dims)).alias("c"))

    def local_energies(self, spark: SparkSession, samples: DataFrame, amplitudes: DataFrame) -> DataFrame:
        """samples (sample_id, possibility, c) with `ws`, `r` = ws^2 / possibility and the real local energy `e`.

        Elements are joined to samples by their points' states, targets to the amplitude table (c, amplitude); a target
        without an amplitude has none.
        """
        place = {p: i for i, p in enumerate(self.points)}
        own = samples.join(amplitudes.withColumnRenamed("amplitude", "ws"), "c")
        if any(np.abs(np.imag(m)).max() > 0 for m in self.terms.values()):
            raise NotImplementedError("local energies are real, and a term is complex")
        parts = []
        for t, (key, m) in enumerate(sorted(self.terms.items())):
            dims = [self.dimensions[p] for p in key]
            cells = [(int(x), int(y), float(m[y, x].real)) for y, x in zip(*np.nonzero(m))]
            table = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(v).alias("v")) for x, y, v in cells))
            code = F.lit(0)
            for p, d in zip(key, dims):
                code = code * d + F.get("c", F.lit(place[p]))
            hit = own.select("*", F.explode(F.filter(table, lambda z: z["x"] == code)).alias("z"))
            target, rest = {}, F.col("z")["y"]
            for p, d in reversed(list(zip(key, dims))):
                target[place[p]] = (rest % d).cast("int")
                rest = F.floor(rest / d)
            parts.append(hit.select("sample_id", "possibility", "ws", F.col("z")["v"].alias("v"), F.array(*(target.get(i, F.get("c", F.lit(i))) for i in range(len(place)))).alias("c")))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionAll(p)
        joined = every.join(amplitudes, "c").groupBy("sample_id").agg(F.sum(F.col("v") * F.col("amplitude") / F.col("ws")).alias("e"))
        rows = own.join(joined, "sample_id", "left")
        return rows.select("sample_id", "c", "ws", (F.col("ws") * F.col("ws") / F.col("possibility")).alias("r"), F.coalesce("e", F.lit(0.0)).alias("e"))


def amplitudes(v: Tensor) -> DataFrame:
    """(c, amplitude) of a state vector's non-zero elements."""
    return v.nonzero().df.select(F.array(*(F.col(k).cast("int") for k in v.keys)).alias("c"), F.col("re").alias("amplitude"))


def sweep(spark: SparkSession, state: State, table: dict[tuple[int, ...], float], chains: int, steps: int, start: Callable[[int], list[int]], seed: int = 0) -> DataFrame:
    """(chain_id, step, c): Metropolis chains over non-zero targets of the terms, one task row a chain, for amplitude
    tables small enough to send to each task."""
    terms = []
    place = {p: i for i, p in enumerate(state.points)}
    for key, m in sorted(state.terms.items()):
        dims = [state.dimensions[p] for p in key]
        moves = {}
        for y, x in zip(*np.nonzero(m)):
            moves.setdefault(tuple(int(i) for i in np.unravel_index(x, dims)), []).append(tuple(int(i) for i in np.unravel_index(y, dims)))
        terms.append(([place[p] for p in key], moves))
    shared = spark.sparkContext.broadcast((table, terms))

    def run(batches):
        import pandas as pd

        table, terms = shared.value
        for batch in batches:
            rows = []
            for chain in batch["id"].tolist():
                rng = np.random.default_rng([seed, chain])
                c = list(start(chain))
                for step in range(steps):
                    for where, moves in terms:
                        old = tuple(c[i] for i in where)
                        options = moves.get(old)
                        if not options:
                            continue
                        new = options[int(rng.integers(len(options)))]
                        changed = list(c)
                        for i, x in zip(where, new):
                            changed[i] = x
                        a, b = table.get(tuple(c), 0.0), table.get(tuple(changed), 0.0)
                        back = len(moves.get(new, ())) or 1
                        if a == 0 or rng.random() < (b / a) ** 2 * len(options) / back:
                            c = changed
                    rows.append((chain, step, list(c)))
            yield pd.DataFrame(rows, columns=["chain_id", "step", "c"])

    return spark.range(chains).mapInPandas(run, "chain_id long, step int, c array<int>")


def bundles(terms: Iterable[tuple[Point, ...]]) -> list[list[tuple[Point, ...]]]:
    """Terms in greedy groups whose members share no site, each group updatable at once."""
    out: list[list[tuple[Point, ...]]] = []
    used: list[set[tuple[int, int]]] = []
    for key in terms:
        sites = {p[:2] for p in key}
        for group, own in zip(out, used):
            if not own & sites:
                group.append(key)
                own |= sites
                break
        else:
            out.append([key])
            used.append(sites)
    return out
