"""Measurements, restrictions and initial configurations by name; each registry also imports modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import estimators
from ..operators.lattice import SIGMA_Z, SS, SZ, State, product
from ..operators.sampling import SamplingLattice

Site = tuple[int, int]


class Registry:
    def __init__(self, function: str):
        self.function, self.known = function, {}

    def __call__(self, f: Callable) -> Callable:
        self.known[f.__name__] = f
        return f

    def find(self, name: str | Callable) -> Callable:
        if callable(name):
            return name
        return self.known[name] if name in self.known else getattr(importlib.import_module(name), self.function)


measurements, restrictions, beginnings = Registry("measurement"), Registry("restrict"), Registry("initial_configuration")


@measurements
def Sz(state: State) -> dict[Any, np.ndarray]:
    return {((a, b, 0),): SZ for a, b in state.sites()}


@measurements
def SzSz(state: State) -> dict[Any, np.ndarray]:
    return {((a, b, 0), (a, b + 1, 0)): product(SZ, SZ) for a, b in state.sites() if b + 1 < state.l2}


@measurements
def bond_energy(state: State) -> dict[Any, np.ndarray]:
    return {((a, b, 0), (c, d, 0)): SS for a, b in state.sites() for c, d in ((a + 1, b), (a, b + 1)) if c < state.l1 and d < state.l2}


@measurements
def parity(state: State) -> dict[Any, np.ndarray]:
    return {tuple((a, b, 0) for a, b in state.sites()): product(*[SIGMA_Z] * state.site_number)}


@restrictions
def balanced(c: dict[Site, int]) -> bool:
    """As many spins up as down, or one more."""
    return abs(2 * sum(c.values()) - len(c)) <= len(c) % 2


@beginnings
def neel(c: dict[Site, int]) -> dict[Site, int]:
    return {s: sum(s) % 2 for s in c}


@beginnings
def up(c: dict[Site, int]) -> dict[Site, int]:
    return dict.fromkeys(c, 0)


def measure(spark: SparkSession, lattice: SamplingLattice, samples: DataFrame, name: str | Callable) -> DataFrame:
    """(term, expect, dev) of a measurement's terms on given samples; the term named whole is all of them together."""
    terms = measurements.find(name)(lattice.state)
    keep, parts = lattice.state.terms, []
    rows = samples.select("sample_id", "possibility", "c")
    try:
        for key, m in terms.items():
            own = State(lattice.state.l1, lattice.state.l2, lattice.state.dimensions)
            own.add(key, m)
            lattice.state.terms = own.terms
            elements, tensors, shape, cut = lattice.elements(), lattice.tensors, lattice.shape, lattice.cut
            parts.append((str(tuple(key)), elements))
    finally:
        lattice.state.terms = keep
    sites = sorted(lattice.tensors)
    shared = spark.sparkContext.broadcast((tensors, parts))  # the model and its terms

    def run(batches):
        import pandas as pd

        from ..operators import peps

        tensors, parts = shared.value
        for b in batches:
            out = []
            for id_, p, c in zip(b["sample_id"], b["possibility"], b["c"]):
                c = dict(zip(sites, map(int, c)))
                ws = peps.amplitude(tensors, shape, c, cut)
                values = [peps.local_energy(tensors, shape, e, c, ws, cut) if ws else 0.0 for _, e in parts]
                out += [(id_, t, ws * ws / p, v) for (t, _), v in zip(parts, values)] + [(id_, "whole", ws * ws / p, sum(values))]
            yield pd.DataFrame(out, columns=["sample_id", "term", "r", "e"])

    long = rows.mapInPandas(run, "sample_id long, term string, r double, e double")
    return estimators.observe(long, ["term"], F.col("r"), F.col("e"))
