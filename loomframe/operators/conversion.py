"""From one kind of state to another."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from ..functions.symmetry import Edge, Schema
from ..sources.storage import stored
from . import peps
from .sampling import SamplingLattice
from .simple_update import SIDES, SITES, SimpleUpdate, scaled
from .tensor import Tensor


def sampling_from_simple(su: SimpleUpdate, cut: int = 16) -> SamplingLattice:
    """Each bond's weight goes half to either site."""
    tensors = {}
    for r in su.sites.collect():  # one row a site
        t = np.array(r["data"]).reshape(r["shape"])
        tensors[r["l1"], r["l2"]] = scaled(t, [np.array(r[s]) for s in SIDES], None, 0.5)
    return SamplingLattice(su.state, tensors, cut)


def simple_from_sampling(spark: SparkSession, lattice: SamplingLattice) -> SimpleUpdate:
    """With weights of one."""
    rows = [(*s, list(t.shape), t.ravel().tolist(), *([1.0] * d for d in t.shape[:4])) for s, t in sorted(lattice.tensors.items())]
    return SimpleUpdate(lattice.state, stored(spark.createDataFrame(rows, SITES), "sites"))


def exact_from_sampling(spark: SparkSession, lattice: SamplingLattice, cut: int = 1 << 20) -> Tensor:
    """The state vector, an amplitude a row, computed in tasks."""
    sites = sorted(lattice.tensors)
    dims = [lattice.tensors[s].shape[4] for s in sites]
    names = [f"P_{a}_{b}_0" for a, b in sites]
    shared, shape = spark.sparkContext.broadcast(lattice.tensors), lattice.shape

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for n in b["id"].tolist():
                c = [int(x) for x in np.unravel_index(n, dims)]
                rows.append((*c, peps.amplitude(shared.value, shape, dict(zip(sites, c)), cut)))
            yield pd.DataFrame(rows, columns=[*(f"e_{n}" for n in names), "re"])

    df = spark.range(int(np.prod(dims))).mapInPandas(run, ", ".join([*(f"e_{n} long" for n in names), "re double"]))
    return Tensor(stored(df, "vector"), Schema(tuple(names), tuple(map(Edge.plain, dims))))


def expand_dimension(lattice: SamplingLattice, new: float, noise: float = 0.0, seed: int = 0) -> None:
    """Bonds of the new dimension (a number below or above one that isn't whole is a ratio), the new part being noise; a
    smaller dimension keeps the first states."""
    rng = np.random.default_rng(seed)
    l1, l2 = lattice.shape

    def grown(size: int) -> int:
        return int(new) if isinstance(new, int) else max(1, round(size * new))

    for (a, b), t in sorted(lattice.tensors.items()):
        outer = (b == 0, a == 0, b == l2 - 1, a == l1 - 1)
        shape = [n if edge else grown(n) for n, edge in zip(t.shape[:4], outer)] + [t.shape[4]]
        out = noise * rng.normal(size=shape)
        common = tuple(slice(0, min(x, y)) for x, y in zip(shape, t.shape))
        out[common] = t[common]
        lattice.tensors[a, b] = out


def squash(lattice: SamplingLattice) -> dict[peps.Site, np.ndarray]:
    """Neighbouring columns merged pair by pair: physical states of a pair in row-major order."""
    l1, l2 = lattice.shape
    if l2 % 2:
        raise ValueError("an even number of columns is needed")
    out = {}
    for i in range(l1):
        for j in range(0, l2, 2):
            x, y = lattice.tensors[i, j], lattice.tensors[i, j + 1]
            t = np.einsum("lurdp,rURDq->luURdDpq", x, y)
            s = t.shape
            out[i, j // 2] = t.reshape(s[0], s[1] * s[2], s[3], s[4] * s[5], s[6] * s[7])
    return out


def unsquash(tensors: dict[peps.Site, np.ndarray], lattice: SamplingLattice, cut: int) -> SamplingLattice:
    """Pairs taken apart again by singular values, at most `cut` states on the bond inside a pair."""
    out = {}
    for (i, j), t in tensors.items():
        x, y = lattice.tensors[i, 2 * j], lattice.tensors[i, 2 * j + 1]
        a = t.reshape(t.shape[0], x.shape[1], y.shape[1], t.shape[2], x.shape[3], y.shape[3], x.shape[4], y.shape[4])
        m = a.transpose(0, 1, 4, 6, 2, 3, 5, 7)
        left, right = m.shape[:4], m.shape[4:]
        u, s, v = np.linalg.svd(m.reshape(int(np.prod(left)), -1), full_matrices=False)
        k = min(cut, len(s))
        root = np.sqrt(s[:k])
        out[i, 2 * j] = (u[:, :k] * root).reshape(*left, k).transpose(0, 1, 4, 2, 3)
        out[i, 2 * j + 1] = (root[:, None] * v[:k]).reshape(k, *right)
    return SamplingLattice(lattice.state, out, lattice.cut)
