"""Models by name: functions that make a lattice state; others can be registered or imported."""

from __future__ import annotations

import importlib
import itertools
import os
import sys
from collections.abc import Callable
from types import ModuleType

import numpy as np

from ..operators.lattice import SIGMA_X, SIGMA_Y, SIGMA_Z, SS, SX, SY, SZ, State, product
from ..operators.neural import NETWORKS, Network

MODELS: dict[str, Callable[..., State]] = {}


def model(f: Callable[..., State]) -> Callable[..., State]:
    MODELS[f.__name__] = f
    return f


def _imported(name: str) -> ModuleType:
    places = [os.getcwd(), *os.environ.get("LOOMPATH", "").split(os.pathsep)]
    sys.path[:0] = [p for p in places if p and p not in sys.path]
    return importlib.import_module(name)


def find(name: str) -> Callable[..., State]:
    """A registered model, else `abstract_state` of a module in the current folder, on $LOOMPATH, or importable."""
    return MODELS[name] if name in MODELS else _imported(name).abstract_state


def network(name: str) -> Callable[..., Network]:
    """A network of the library, else `network` of a module found as those of models are."""
    return NETWORKS[name] if name in NETWORKS else _imported(name).network


def _spins(l1: int, l2: int, orbits: int = 1) -> State:
    s = State(l1, l2)
    s.set_physics(2, orbits)
    return s


def _bonds(s: State, m: np.ndarray) -> None:
    s.set_terms("vertical_bond", m)
    s.set_terms("horizontal_bond", m)


@model
def ising(l1: int, l2: int, J: float = 1.0, g: float = 1.0) -> State:
    s = _spins(l1, l2)
    _bonds(s, -J * product(SIGMA_Z, SIGMA_Z))
    s.set_terms("single_site", -J * g * SIGMA_X)
    return s


@model
def heisenberg(l1: int, l2: int, J: float = -1.0) -> State:
    s = _spins(l1, l2)
    _bonds(s, -J * SS)
    return s


@model
def J1J2(l1: int, l2: int, J1: float = 1.0, J2: float = 0.5) -> State:
    s = _spins(l1, l2)
    _bonds(s, J1 * SS)
    for a, b in itertools.product(range(l1 - 1), range(l2 - 1)):
        s.add([(a, b, 0), (a + 1, b + 1, 0)], J2 * SS)
        s.add([(a + 1, b, 0), (a, b + 1, 0)], J2 * SS)
    return s


@model
def kitaev(l1: int, l2: int, Jx: float = 1.0, Jy: float = 1.0, Jz: float = 1.0) -> State:
    """Two orbits a site: z inside a site, x and y between neighbours."""
    s = _spins(l1, l2, 2)
    for a, b in s.sites():
        s.add([(a, b, 0), (a, b, 1)], Jz * product(SZ, SZ))
        if a:
            s.add([(a - 1, b, 1), (a, b, 0)], Jx * product(SX, SX))
        if b:
            s.add([(a, b - 1, 1), (a, b, 0)], Jy * np.real(product(SY, SY)))
    return s


@model
def toric_code(l1: int, l2: int, Jx: float = 1.0, Jz: float = 1.0) -> State:
    s = _spins(l1, l2)
    for a, b in itertools.product(range(l1 - 1), range(l2 - 1)):
        m, j = (SIGMA_X, Jx) if (a + b) % 2 == 0 else (SIGMA_Z, Jz)
        s.add([(a, b, 0), (a, b + 1, 0), (a + 1, b, 0), (a + 1, b + 1, 0)], -j * product(m, m, m, m))
    return s


@model
def rydberg(l1: int, l2: int, omega: float = 1.0, delta: float = 1.0, radius: float = 1.5) -> State:
    """Site terms, and pairs closer than `radius` with the sixth power of the distance."""
    s = _spins(l1, l2)
    n = (np.eye(2) - SIGMA_Z) / 2
    s.set_terms("single_site", omega / 2 * SIGMA_X - delta * n)
    for (a, b), (c, d) in itertools.combinations(s.sites(), 2):
        r = np.hypot(a - c, b - d)
        if r < radius:
            s.add([(a, b, 0), (c, d, 0)], omega / r**6 * product(n, n))
    return s


@model
def gibbs_heisenberg(l1: int, l2: int, J: float = -1.0) -> State:
    """Two layers, orbit 0 and 1 of each site, with the bonds of each."""
    s = _spins(l1, l2, 2)
    for o in (0, 1):
        for a, b in s.sites():
            for c, d in ((a + 1, b), (a, b + 1)):
                if c < l1 and d < l2:
                    s.add([(a, b, o), (c, d, o)], -J * SS)
    return s


@model
def gibbs_J1J2(l1: int, l2: int, J1: float = 1.0, J2: float = 0.5, side: int = 1) -> State:
    """A density matrix: orbit 0 and 1 of each site are its two sides, and terms act on the first or on both."""
    s = _spins(l1, l2, 2)
    for o in range(side):
        for a, b in s.sites():
            for c, d, j in ((a + 1, b, J1), (a, b + 1, J1), (a + 1, b + 1, J2), (a + 1, b - 1, J2)):
                if c < l1 and 0 <= d < l2:
                    s.add([(a, b, o), (c, d, o)], -j * SS)
    return s


@model
def boson_metal(l1: int, l2: int, J: float = 1.0, K: float = 1.0, mu: float = 0.0) -> State:
    """Hard-core bosons that hop on bonds and turn opposite corners of plaquettes around."""
    s = _spins(l1, l2)
    up = np.array([[0.0, 1.0], [0.0, 0.0]])
    ring = product(up, up.T, up.T, up)  # in the order of the corners (a, b), (a, b + 1), (a + 1, b), (a + 1, b + 1)
    _bonds(s, 0.5 * J * np.real(product(SIGMA_X, SIGMA_X) + product(SIGMA_Y, SIGMA_Y)))
    s.set_terms("single_site", -mu * (SIGMA_Z + np.eye(2)) / 2)
    for a, b in itertools.product(range(l1 - 1), range(l2 - 1)):
        s.add([(a, b, 0), (a, b + 1, 0), (a + 1, b, 0), (a + 1, b + 1, 0)], K * (ring + ring.T))
    return s


@model
def cluster_heisenberg(l1: int, l2: int, c1: int, c2: int, J: float = -1.0) -> State:
    """Spins of an l1 x l2 lattice, gathered in c1 x c2 sites with several orbits each."""
    members: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b in itertools.product(range(l1), range(l2)):
        members.setdefault((c1 * a // l1, c2 * b // l2), []).append((a, b))
    point = {spin: (*cell, o) for cell, own in members.items() for o, spin in enumerate(own)}
    s = State(c1, c2)
    s.dimensions = dict.fromkeys(point.values(), 2)
    for a, b in point:
        for other in ((a + 1, b), (a, b + 1)):
            if other in point:
                s.add([point[a, b], point[other]], -J * SS)
    return s


@model
def kagome_heisenberg(l1: int, l2: int, J: float = -1.0) -> State:
    """Three spins a cell: a corner, the middle of the bond down and the middle of the bond to the right."""
    s = State(l1, l2)
    s.dimensions = {(a, b, o): 2 for a, b in s.sites() for o in range(3) if o == 0 or (o == 1 and a < l1 - 1) or (o == 2 and b < l2 - 1)}
    for a, b in s.sites():
        triangles = [(a, b, 0), (a, b, 1), (a, b, 2)], [(a + 1, b + 1, 0), (a, b + 1, 1), (a + 1, b, 2)]
        pairs = [p for t in triangles for p in itertools.combinations(t, 2) if (t is triangles[0] or t[0] not in p)]
        pairs += [((a, b, 1), (a + 1, b, 0)), ((a, b, 2), (a, b + 1, 0))]
        for x, y in pairs:
            if x in s.dimensions and y in s.dimensions:
                s.add([x, y], -J * SS)
    return s


@model
def free_fermion(l1: int, l2: int, t: float = 1.0) -> State:
    """Hopping of spinless fermions, as spins in the order of sites: a hop has the parity of the sites between."""
    s = _spins(l1, l2)
    order = s.points
    up, down = np.array([[0, 1], [0, 0]]), np.array([[0, 0], [1, 0]])
    for a, b in s.sites():
        for c, d in ((a + 1, b), (a, b + 1)):
            if c < l1 and d < l2:
                i, j = order.index((a, b, 0)), order.index((c, d, 0))
                between = [SIGMA_Z] * (j - i - 1)
                hop = product(up, *between, down) + product(down, *between, up)
                s.add(order[i : j + 1], t * hop)
    return s


__all__ = ["MODELS", "SIGMA_Y", "find", "model"]
