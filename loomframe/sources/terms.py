"""Hamiltonian terms from tables of creation and annihilation operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lattice import SIGMA_Z, State

UP, DOWN = np.array([[0.0, 1.0], [0.0, 0.0]]), np.array([[0.0, 0.0], [1.0, 0.0]])


def fermion_terms(terms: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(sites, daggers, coefficient): rows above the threshold, equal operator strings added; only strings of two or
    four operators are allowed."""
    wrong = terms.filter(~F.size("sites").isin(0, 2, 4) | (F.size("sites") != F.size("daggers"))).limit(1).count()
    if wrong:
        raise ValueError("only strings of two or four operators are read")
    return terms.filter(F.abs("coefficient") > threshold).groupBy("sites", "daggers").agg(F.sum("coefficient").alias("coefficient"))


def state_from_terms(terms: DataFrame, l1: int, l2: int, threshold: float = 0.0) -> State:
    """A lattice of spins on which the strings act, fermion signs being strings of sigma z over earlier sites.

    Terms are a model's, not data: their number is bounded by the lattice.
    """
    state = State(l1, l2)
    state.set_physics(2)
    points = state.points
    for row in fermion_terms(terms, threshold).orderBy("sites", "daggers").collect():
        if not row["sites"]:
            state.add([points[0]], row["coefficient"] * np.eye(2))
            continue
        high = max(row["sites"])
        out = np.eye(2 ** (high + 1))
        for site, dagger in zip(row["sites"], row["daggers"]):
            m = np.eye(1)
            for k in range(high + 1):
                m = np.kron(m, SIGMA_Z if k < site else (DOWN if dagger else UP) if k == site else np.eye(2))
            out = out @ m
        state.add(points[: high + 1], row["coefficient"] * out)
    return state
