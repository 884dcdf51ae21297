"""Exact states: a Hamiltonian as a sum of terms applied to a state vector held as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F

from ..sources.storage import stored
from .tensor import Tensor


def _kept(t: Tensor) -> Tensor:
    return Tensor(stored(t.df, "vector"), t.schema)


def _norm(t: Tensor) -> float:
    return float(t.norms().first()["n_2"])


def inner(a: Tensor, b: Tensor) -> float:
    """Re <a|b>, conjugating the first."""
    if not a.schema.is_complex and not b.schema.is_complex:
        return float((a * b).df.agg({"re": "sum"}).first()[0] or 0.0)
    # Re(conj(x) y) goes by components.
    return float(a.to_complex().zip(b, lambda x, y: x * y, "inner").df.agg(F.sum(F.col("re") + F.col("im"))).first()[0] or 0.0)


def ground_state(apply: Callable[[Tensor], Tensor], start: Tensor, steps: int) -> tuple[float, Tensor]:
    """Lanczos: the lowest energy and its vector after at least two steps. Vectors are stored tables; the driver has the
    tridiagonal matrix alone. Stops early where the space closes."""
    if steps < 2:
        raise ValueError("at least two steps are needed")
    vectors, alphas, betas = [_kept(start * (1 / _norm(start)))], [], []
    for step in range(steps):
        w = _kept(apply(vectors[-1]))
        alphas.append(inner(vectors[-1], w))
        if step == steps - 1:
            break
        w = w - vectors[-1] * alphas[-1]
        if len(vectors) > 1:
            w = w - vectors[-2] * betas[-1]
        w = _kept(w)
        beta = _norm(w)
        if beta < 1e-12:
            break
        betas.append(beta)
        vectors.append(_kept(w * (1 / beta)))
    n = len(alphas)
    h = np.diag(alphas) + np.diag(betas[: n - 1], 1) + np.diag(betas[: n - 1], -1)
    energies, states = np.linalg.eigh(h)
    out = vectors[0] * float(states[0, 0])
    for v, c in list(zip(vectors, states[:, 0]))[1:n]:
        out = out + v * float(c)
    return float(energies[0]), out
