"""Fermion lattices in the occupation basis: a state is a long whose bits are the modes' occupations, a vector is a table
(e_s, re), and a Hamiltonian is a short list of operator strings applied by JVM expressions.

A string is a coefficient and its operators, (mode, creates), the last of which acts first. An operator on mode m has the
sign of the occupied modes below m. Conserved numbers are groups of modes with their total; states outside are never made.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.symmetry import NO, Schema
from . import exact
from .tensor import Tensor

Operators = tuple[tuple[int, bool], ...]


def creates(m: int) -> tuple[int, bool]:
    return m, True


def destroys(m: int) -> tuple[int, bool]:
    return m, False


@dataclass
class FermionLattice:
    """Modes (at most 62), strings, conserved numbers as (modes, total), and groups of modes of which at most one is
    occupied."""

    modes: int
    sites: int
    strings: dict[Operators, float] = field(default_factory=dict)
    conserved: list[tuple[tuple[int, ...], int]] = field(default_factory=list)
    exclusive: list[tuple[int, ...]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not 1 <= self.modes <= 62:
            raise ValueError("a state has 1 to 62 modes")

    def add(self, coefficient: float, *operators: tuple[int, bool]) -> None:
        """Equal strings are added up; what comes to zero goes."""
        if any(not 0 <= m < self.modes for m, _ in operators):
            raise ValueError(f"no such mode: {operators}")
        self.strings[operators] = self.strings.get(operators, 0.0) + float(coefficient)
        if self.strings[operators] == 0:
            del self.strings[operators]

    def add_hop(self, coefficient: float, a: int, b: int) -> None:
        self.add(coefficient, creates(a), destroys(b))
        self.add(coefficient, creates(b), destroys(a))

    def add_number(self, coefficient: float, *modes: int) -> None:
        """The product of the modes' occupations."""
        self.add(coefficient, *(o for m in modes for o in (creates(m), destroys(m))))

    def add_pair(self, coefficient: float, a: int, b: int) -> None:
        """c_a c_b and its conjugate."""
        self.add(coefficient, destroys(a), destroys(b))
        self.add(coefficient, creates(b), creates(a))

    def check_hermite(self, threshold: float = 1e-12) -> None:
        there = normal_ordered(self.strings)
        back = normal_ordered({tuple((m, not d) for m, d in reversed(o)): c for o, c in self.strings.items()})
        for operators in there.keys() | back.keys():
            if abs(there.get(operators, 0.0) - back.get(operators, 0.0)) > threshold:
                raise ValueError(f"{operators} has no conjugate")

    @staticmethod
    def _mask(modes: Iterable[int]) -> int:
        return sum(1 << m for m in set(modes))

    def allowed(self, state: Column) -> Column:
        """Whether a state has the conserved numbers and keeps the exclusions."""
        ok = F.lit(True)
        for modes, total in self.conserved:
            ok &= F.bit_count(state.bitwiseAND(F.lit(self._mask(modes)))) == total
        for modes in self.exclusive:
            ok &= F.bit_count(state.bitwiseAND(F.lit(self._mask(modes)))) <= 1
        return ok

    def basis(self, spark: SparkSession) -> DataFrame:
        return spark.range(1 << self.modes).select(F.col("id").alias("e_s")).filter(self.allowed(F.col("e_s")))

    def random_vector(self, spark: SparkSession, seed: int = 0) -> Tensor:
        noise = F.pmod(F.xxhash64("e_s", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53) - 0.5
        return Tensor(self.basis(spark).select("e_s", noise.alias("re")), Schema(("s",), (None,), NO))

    def apply(self, v: Tensor) -> Tensor:
        """H v: each row is sent to the targets of all strings, which are summed once; the plan doesn't grow with them."""
        return apply_strings(v, self.strings, self.allowed)

    def ground_state(self, spark: SparkSession, steps: int, seed: int = 0) -> tuple[float, Tensor]:
        """Lowest energy per site and its vector."""
        energy, v = exact.ground_state(self.apply, self.random_vector(spark, seed), steps)
        return energy / self.sites, v

    def observe(self, v: Tensor, strings: dict[Operators, float]) -> float:
        """<v| O |v> / <v|v>."""
        return exact.inner(v, apply_strings(v, strings, self.allowed)) / exact.inner(v, v)


def normal_ordered(strings: dict[Operators, float]) -> dict[Operators, float]:
    """The same sum with creators in front, both kinds by descending mode."""
    out: dict[Operators, float] = {}
    left = list(strings.items())
    while left:
        ops, c = left.pop()
        for i, (x, y) in enumerate(zip(ops, ops[1:])):
            if x == y:
                break  # twice the same operator is nothing
            if (y[1], y[0]) > (x[1], x[0]):
                left.append(((*ops[:i], y, x, *ops[i + 2 :]), -c))
                if x[0] == y[0]:
                    left.append(((*ops[:i], *ops[i + 2 :]), c))
                break
        else:
            out[ops] = out.get(ops, 0.0) + c
    return out


def sign(state: Column, mode: Column) -> Column:
    """-1 where an odd number of modes below is occupied."""
    below = state.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), mode) - 1)
    return F.when(F.bit_count(below) % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))


def apply_strings(v: Tensor, strings: dict[Operators, float], allowed=None) -> Tensor:
    if not strings:
        return replace_rows(v, v.df.filter("false"))
    table = F.array(*(F.struct(F.lit(c).alias("c"), F.array(*(F.struct(F.lit(m).alias("m"), F.lit(1 if d else 0).cast("long").alias("d")) for m, d in reversed(o))).alias("ops")) for o, c in sorted(strings.items())))

    def act(state: Column, op: Column) -> Column:
        at = F.call_function("shiftleft", F.lit(1).cast("long"), op["m"])
        occupied = F.when(state["s"].bitwiseAND(at) != 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.struct(state["s"].bitwiseXOR(at).alias("s"), F.when(occupied == op["d"], F.lit(0.0)).otherwise(state["v"] * sign(state["s"], op["m"])).alias("v"))

    rows = v.df.select("e_s", "re", F.explode(table).alias("t"))
    out = F.aggregate(F.col("t.ops"), F.struct(F.col("e_s").alias("s"), (F.col("re") * F.col("t.c")).alias("v")), act)
    rows = rows.select(out.alias("o")).select(F.col("o.s").alias("e_s"), F.col("o.v").alias("re")).filter(F.col("re") != 0)
    if allowed is not None:
        rows = rows.filter(allowed(F.col("e_s")))
    return replace_rows(v, rows.groupBy("e_s").agg(F.sum("re").alias("re")))


def replace_rows(v: Tensor, rows: DataFrame) -> Tensor:
    return Tensor(rows.select("e_s", "re"), v.schema)


def bonds(l1: int, l2: int) -> list[tuple[int, int]]:
    """Neighbouring sites of an open square lattice, sites numbered row by row."""
    out = []
    for a, b in itertools.product(range(l1), range(l2)):
        out += [(a * l2 + b, c * l2 + d) for c, d in ((a + 1, b), (a, b + 1)) if c < l1 and d < l2]
    return out


def free_fermion(l1: int, l2: int, T: int, t: float = 1.0) -> FermionLattice:
    """Hopping of T spinless fermions."""
    n = l1 * l2
    out = FermionLattice(n, n, conserved=[(tuple(range(n)), T)])
    for a, b in bonds(l1, l2):
        out.add_hop(t, a, b)
    return out


def tV(l1: int, l2: int, T: int, t: float = 1.0, V: float = 1.0) -> FermionLattice:
    """Spinless fermions that hop and repel their neighbours."""
    out = free_fermion(l1, l2, T, -t)
    for a, b in bonds(l1, l2):
        out.add_number(V, a, b)
    return out


def _spinful(sites: int, T: int, up: int | None = None) -> FermionLattice:
    """Modes 2 * site (up) and 2 * site + 1 (down), T particles in all, and `up` of them up if given."""
    out = FermionLattice(2 * sites, sites, conserved=[(tuple(range(2 * sites)), T)])
    if up is not None:
        out.conserved.append((tuple(range(0, 2 * sites, 2)), up))
    return out


def hubbard(l1: int, l2: int, T: int, t: float = 1.0, U: float = 8.0, up: int | None = None) -> FermionLattice:
    out = _spinful(l1 * l2, T, up)
    for a, b in bonds(l1, l2):
        for s in (0, 1):
            out.add_hop(-t, 2 * a + s, 2 * b + s)
    for a in range(l1 * l2):
        out.add_number(U, 2 * a, 2 * a + 1)
    return out


def honeycomb_hubbard(l1: int, l2: int, T: int, t: float = 1.0, U: float = 8.0) -> FermionLattice:
    """Two sites a cell, but for one missing in the first cell and one in the last."""
    cells = list(itertools.product(range(l1), range(l2)))
    sites = [(a, b, o) for a, b in cells for o in (0, 1) if (a, b, o) not in ((0, 0, 0), (l1 - 1, l2 - 1, 1))]
    number = {s: i for i, s in enumerate(sites)}
    out = _spinful(len(sites), T)
    for a, b, o in sites:
        out.add_number(U, 2 * number[a, b, o], 2 * number[a, b, o] + 1)
        for other in ((a, b, 1), (a - 1, b, 1), (a, b - 1, 1)) if o == 0 else ():
            if other in number:
                for s in (0, 1):
                    out.add_hop(-t, 2 * number[a, b, 0] + s, 2 * number[other] + s)
    return out


def tJ(l1: int, l2: int, T: int, t: float = 1.0, J: float = 0.4, up: int | None = None) -> FermionLattice:
    """Hopping without double occupancy, and J (S . S - n n / 4) on bonds, by occupations and exchanges."""
    out = _spinful(l1 * l2, T, up)
    out.exclusive = [(2 * a, 2 * a + 1) for a in range(l1 * l2)]
    for a, b in bonds(l1, l2):
        for s in (0, 1):
            out.add_hop(-t, 2 * a + s, 2 * b + s)
            # S^z S^z - n n / 4 is -1/2 for opposite spins and nothing else.
            out.add_number(-J / 2, 2 * a + s, 2 * b + 1 - s)
            out.add(J / 2, creates(2 * a + s), destroys(2 * a + 1 - s), creates(2 * b + 1 - s), destroys(2 * b + s))
    return out


def bcs(l1: int, l2: int, t: float = 1.0, D: float = 1.0, mu: float = 0.0) -> FermionLattice:
    """Spinless fermions with pairing on bonds; numbers aren't conserved."""
    n = l1 * l2
    out = FermionLattice(n, n)
    for a, b in bonds(l1, l2):
        out.add_hop(-t, a, b)
        out.add_pair(D, a, b)
    for a in range(n):
        out.add_number(-mu, a)
    return out


LATTICES = {f.__name__: f for f in (free_fermion, tV, hubbard, honeycomb_hubbard, tJ, bcs)}
