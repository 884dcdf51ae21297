"""Imaginary-time simple update of a lattice of site tensors without symmetry.

Sites are rows (l1, l2, shape, data, left, up, right, down): the tensor's axes are L, U, R, D and the physical one, and
the four last columns are the weights of the bonds around it. Terms are dealt into bundles that share no site; a bundle is
one DataFrame job, in which each term's sites meet in one task, and every other site passes through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.symmetry import Edge, Schema
from ..sources.storage import drop_stored, stored
from .lattice import Point, State, bundles
from .linear_algebra import expm
from .tensor import Tensor

SITES = "l1 int, l2 int, shape array<int>, data array<double>, left array<double>, up array<double>, right array<double>, down array<double>"
SIDES = ("left", "up", "right", "down")


Gate = tuple[tuple[Point, ...], np.ndarray]


def distance(key: tuple[Point, ...]) -> int:
    return abs(key[0][0] - key[1][0]) + abs(key[0][1] - key[1][1])


def routed(key: tuple[Point, Point], u: np.ndarray, dimensions: dict[Point, int]) -> list[Gate]:
    """Gates on neighbours that do what u does to two distant sites: the first site's state is swapped along a path to the
    other site, and back afterwards."""
    (a, b, _), (c, d, _) = key
    path = [(i, b, 0) for i in range(a, c + (1 if c >= a else -1), 1 if c >= a else -1)]
    path += [(c, j, 0) for j in range(b + (1 if d > b else -1), d + (1 if d > b else -1), 1 if d > b else -1)] if d != b else []
    if len({dimensions[p] for p in path}) > 1:
        raise NotImplementedError("sites of several dimensions can't be swapped")
    n = dimensions[path[0]]
    swap = np.eye(n * n).reshape(n, n, n, n).transpose(1, 0, 2, 3).reshape(n * n, n * n)
    there = [(tuple(sorted(path[i : i + 2])), swap) for i in range(len(path) - 2)]
    x, y = path[-2:]
    turned = u if x < y else u.reshape(n, n, n, n).transpose(1, 0, 3, 2).reshape(n * n, n * n)
    return [*there, ((min(x, y), max(x, y)), turned), *there[::-1]]


def scaled(a: np.ndarray, weights: list[np.ndarray], skip: int | None, power: float) -> np.ndarray:
    for axis, w in enumerate(weights):
        if axis != skip:
            a = a * (w**power).reshape([-1 if i == axis else 1 for i in range(a.ndim)])
    return a


def joined(a: np.ndarray, b: np.ndarray, wa: list[np.ndarray], wb: list[np.ndarray], axis: int, u: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two neighbours after u acted on both, with at most `cut` states on their bond (axis of a, axis - 2 of b), and its
    weights, of norm one."""
    other = axis - 2
    x = np.moveaxis(scaled(a, wa, axis, 1.0), (axis, 4), (-2, -1))
    y = np.moveaxis(scaled(b, wb, other, 1.0), (other, 4), (-2, -1))
    qa, ra = np.linalg.qr(x.reshape(-1, x.shape[-2] * x.shape[-1]))
    qb, rb = np.linalg.qr(y.reshape(-1, y.shape[-2] * y.shape[-1]))
    da, db = x.shape[-1], y.shape[-1]
    w = wa[axis]
    theta = np.einsum("aip,i,biq->abpq", ra.reshape(-1, len(w), da), w, rb.reshape(-1, len(w), db))
    theta = np.einsum("abpq,rspq->arbs", theta, u.reshape(da, db, da, db))
    left, s, right = np.linalg.svd(theta.reshape(theta.shape[0] * da, -1), full_matrices=False)
    keep = max(1, min(cut, int((s > 1e-14 * s[0]).sum())))
    s = s[:keep] / np.linalg.norm(s[:keep])
    na = np.einsum("xa,apk->xkp", qa, left[:, :keep].reshape(-1, da, keep)).reshape(*x.shape[:-2], keep, da)
    nb = np.einsum("xb,kbq->xkq", qb, right[:keep].reshape(keep, -1, db)).reshape(*y.shape[:-2], keep, db)
    na, nb = np.moveaxis(na, (-2, -1), (axis, 4)), np.moveaxis(nb, (-2, -1), (other, 4))
    return scaled(na, wa, axis, -1.0), scaled(nb, wb, other, -1.0), s


@dataclass
class SimpleUpdate:
    state: State
    sites: DataFrame

    @classmethod
    def create(cls, spark: SparkSession, state: State, dimension: int, seed: int = 0) -> SimpleUpdate:
        state.check_simple()
        rows = []
        for a, b in state.sites():
            shape = [1 if b == 0 else dimension, 1 if a == 0 else dimension, 1 if b == state.l2 - 1 else dimension, 1 if a == state.l1 - 1 else dimension, state.dimensions[a, b, 0]]
            data = np.random.default_rng([seed, a, b]).normal(size=shape)
            rows.append((a, b, shape, data.ravel().tolist(), *([1.0] * d for d in shape[:4])))
        return cls(state, stored(spark.createDataFrame(rows, SITES), "sites"))

    def update(self, steps: int, delta: float, cut: int) -> None:
        """Each step applies exp(-delta H) term by term, bundles forward and then backward. Terms of two distant sites go
        after the bundles, each by way of swaps along a path between its sites."""
        self.state.check_simple()
        near = [k for k in sorted(self.state.terms) if len(k) == 1 or (len(k) == 2 and distance(k) == 1)]
        far = [k for k in sorted(self.state.terms) if len(k) == 2 and distance(k) > 1]
        if len(near) + len(far) < len(self.state.terms):
            raise NotImplementedError("terms of three and more sites aren't updated")
        gate = {k: expm(-delta * np.asarray(np.real(m), float)) for k, m in self.state.terms.items()}
        groups = [[(k, gate[k]) for k in group] for group in bundles(near)]
        groups += [[g] for k in far for g in routed(k, gate[k], self.state.dimensions)]
        first = self.sites
        for _ in range(steps):
            for group in [*groups, *reversed(groups)]:  # a routed term's gates read alike from both ends
                last, self.sites = self.sites, stored(self._bundle(group, cut), "sites")
                if last is not first:  # which others may read
                    drop_stored(last)

    def _bundle(self, group: list[Gate], cut: int) -> DataFrame:
        spark, rows = self.sites.sparkSession, []
        for t, (key, u) in enumerate(group):
            rows += [(t, p[0], p[1], u.ravel().tolist()) for p in key]
        tasks = spark.createDataFrame(rows, "term int, l1 int, l2 int, u array<double>")
        # A site without a term is a group of its own.
        dealt = self.sites.join(F.broadcast(tasks), ["l1", "l2"], "left").withColumn("group", F.coalesce(F.col("term").cast("string"), F.concat_ws(",", "l1", "l2")))
        names = ["l1", "l2", "shape", "data", *SIDES]

        def kernel(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["l1", "l2"]).reset_index(drop=True)
            if part["u"].iloc[0] is None:
                return part[names]
            tensors = [np.array(r.data).reshape(list(r.shape)) for r in part[["data", "shape"]].rename(columns={"shape": "form"}).assign(shape=part["shape"]).itertuples()]
            weights = [[np.array(part[s].iloc[i]) for s in SIDES] for i in range(len(part))]
            u = np.array(part["u"].iloc[0])
            if len(part) == 1:
                d = tensors[0].shape[4]
                tensors[0] = tensors[0] @ u.reshape(d, d).T
                tensors[0] = tensors[0] / np.linalg.norm(tensors[0])
            else:
                axis = 2 if part["l1"].iloc[0] == part["l1"].iloc[1] else 3
                a, b, s = joined(*tensors, *weights, axis, u, cut)
                tensors, weights[0][axis], weights[1][axis - 2] = [a, b], s, s
            return pd.DataFrame({"l1": part["l1"], "l2": part["l2"], "shape": [list(t.shape) for t in tensors], "data": [t.ravel().tolist() for t in tensors], **{s: [w[i].tolist() for w in weights] for i, s in enumerate(SIDES)}})

        return dealt.groupBy("group").applyInPandas(kernel, SITES)

    def observe(self, terms: dict[tuple[Point, ...], np.ndarray]) -> dict[tuple[Point, ...], float]:
        """Expectations of operators on one site or on two neighbours, the bond weights standing for the rest of the
        lattice. Each is computed in a task of its own from its sites alone, so nothing grows with the lattice's states."""
        spark = self.sites.sparkSession
        keys = sorted(terms)
        rows = []
        for t, key in enumerate(keys):
            if len(key) > 2 or (len(key) == 2 and abs(key[0][0] - key[1][0]) + abs(key[0][1] - key[1][1]) != 1):
                raise NotImplementedError("only operators on one site or on neighbours are observed")
            rows += [(t, p[0], p[1], np.real(terms[key]).ravel().tolist()) for p in key]
        own = spark.createDataFrame(rows, "term int, l1 int, l2 int, o array<double>").join(self.sites, ["l1", "l2"])

        def kernel(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["l1", "l2"]).reset_index(drop=True)
            tensors = [np.array(part["data"].iloc[i]).reshape(list(part["shape"].iloc[i])) for i in range(len(part))]
            weights = [[np.array(part[s].iloc[i]) for s in SIDES] for i in range(len(part))]
            o = np.array(part["o"].iloc[0])
            if len(part) == 1:
                d = tensors[0].shape[4]
                psi = scaled(tensors[0], weights[0], None, 1.0).reshape(-1, d)
            else:
                axis = 2 if part["l1"].iloc[0] == part["l1"].iloc[1] else 3
                a = scaled(tensors[0], weights[0], None, 1.0)  # carries the weight of the bond between
                b = scaled(tensors[1], weights[1], axis - 2, 1.0)
                x = np.tensordot(a, b, ([axis], [axis - 2]))  # three sides and the state of either site
                psi = np.moveaxis(x, 3, -2).reshape(-1, a.shape[4] * b.shape[4])
            rho = psi.T @ psi
            return pd.DataFrame({"term": [part["term"].iloc[0]], "v": [float((rho * o.reshape(rho.shape)).sum() / np.trace(rho))]})

        found = own.groupBy("term").applyInPandas(kernel, "term int, v double").collect()  # a number an operator
        return {keys[r["term"]]: r["v"] for r in found}

    def environment_energy(self) -> float:
        """Energy per site by `observe`."""
        return sum(self.observe(self.state.terms).values()) / self.state.site_number

    def to_exact(self, spark: SparkSession) -> Tensor:
        """The state vector, contracted site by site; for small lattices."""
        rows = {(r["l1"], r["l2"]): r for r in self.sites.collect()}  # one row a site
        out, labels = np.ones(()), []
        for (a, b), r in sorted(rows.items()):
            t = np.array(r["data"]).reshape(r["shape"])
            t = scaled(t, [np.array(r[s]) for s in SIDES], None, 0.5)
            own = [("h", a, b - 1), ("v", a - 1, b), ("h", a, b), ("v", a, b), ("p", a, b)]
            shared = [x for x in own if x in labels]
            out = np.tensordot(out, t, ([labels.index(x) for x in shared], [own.index(x) for x in shared]))
            labels = [x for x in labels if x not in shared] + [x for x in own if x not in shared]
        names = [x for x in labels if x[0] == "p"]
        out = out.reshape([n for x, n in zip(labels, out.shape) if x[0] == "p"] if all(n == 1 for x, n in zip(labels, out.shape) if x[0] != "p") else out.shape)
        out = out / np.linalg.norm(out)
        edges = [f"P_{a}_{b}_0" for _, a, b in names]
        data = [(*map(int, i), float(out[i])) for i in np.ndindex(out.shape)]
        df = spark.createDataFrame(data, ", ".join([*(f"e_{n} long" for n in edges), "re double"]))
        return Tensor(df, Schema(tuple(edges), tuple(map(Edge.plain, out.shape))))

    def energy(self, spark: SparkSession) -> float:
        """Energy per site of the exact contraction."""
        from . import exact

        v = self.to_exact(spark)
        v = Tensor(stored(v.df, "vector"), v.schema)
        return exact.inner(v, self.state.apply(spark, v)) / exact.inner(v, v) / self.state.site_number
