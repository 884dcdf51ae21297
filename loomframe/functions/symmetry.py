"""Charges, edges and tensor schemas: small driver-side objects, never data."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

Charge = tuple[int, ...]


@dataclass(frozen=True)
class Symmetry:
    """One entry a charge component: its kind, "u1" (integers) or "z2" (parity), and whether it is fermionic."""

    kinds: tuple[str, ...] = ()
    fermi: tuple[bool, ...] = ()

    def add(self, *charges: Charge) -> Charge:
        sums = [sum(c[i] for c in charges) for i in range(len(self.kinds))]
        return tuple(s % 2 if k == "z2" else s for s, k in zip(sums, self.kinds))

    def negative(self, q: Charge) -> Charge:
        return tuple(x % 2 if k == "z2" else -x for x, k in zip(q, self.kinds))

    @property
    def zero(self) -> Charge:
        return (0,) * len(self.kinds)

    def parity(self, q: Charge) -> int:
        return sum(x for x, f in zip(q, self.fermi) if f) % 2

    @property
    def is_fermi(self) -> bool:
        return any(self.fermi)


NO = Symmetry()
BOSE_Z2, BOSE_U1 = Symmetry(("z2",), (False,)), Symmetry(("u1",), (False,))
FERMI_Z2, FERMI_U1 = Symmetry(("z2",), (True,)), Symmetry(("u1",), (True,))
FERMI_U1_BOSE_Z2 = Symmetry(("u1", "z2"), (True, False))
FERMI_U1_BOSE_U1 = Symmetry(("u1", "u1"), (True, False))
FERMI_U1_FERMI_U1 = Symmetry(("u1", "u1"), (True, True))
SYMMETRIES = {
    "No": NO, "BoseZ2": BOSE_Z2, "BoseU1": BOSE_U1, "FermiU1": FERMI_U1, "FermiZ2": FERMI_Z2,
    "FermiU1BoseZ2": FERMI_U1_BOSE_Z2, "FermiU1BoseU1": FERMI_U1_BOSE_U1, "FermiU1FermiU1": FERMI_U1_FERMI_U1,
    "Normal": NO, "Z2": BOSE_Z2, "U1": BOSE_U1,
}


@dataclass(frozen=True)
class Edge:
    """Segments (charge, dimension) in order, and the arrow, which matters for fermions alone."""

    segments: tuple[tuple[Charge, int], ...]
    arrow: bool = False

    @classmethod
    def plain(cls, dimension: int) -> Edge:
        return cls((((), dimension),))

    @classmethod
    def of(cls, sizes: dict[int | Charge, int], arrow: bool = False) -> Edge:
        return cls(tuple((q if isinstance(q, tuple) else (q,), d) for q, d in sizes.items()), arrow)

    @property
    def dimension(self) -> int:
        return sum(d for _, d in self.segments)

    @property
    def starts(self) -> list[int]:
        return [0, *itertools.accumulate(d for _, d in self.segments)][:-1]

    def conjugate(self, symmetry: Symmetry) -> Edge:
        return Edge(tuple((symmetry.negative(q), d) for q, d in self.segments), not self.arrow if symmetry.is_fermi else self.arrow)

    def reversed(self) -> Edge:
        return replace(self, arrow=not self.arrow)

    def position_by_charge(self, q: Charge) -> int:
        return [c for c, _ in self.segments].index(q)

    def dimension_by_charge(self, q: Charge) -> int:
        return dict(self.segments)[q]

    def coord_by_index(self, index: int) -> tuple[int, int]:
        for p, (start, (_, d)) in enumerate(zip(self.starts, self.segments)):
            if index < start + d:
                return p, index - start
        raise IndexError(index)

    def index_by_coord(self, position: int, offset: int) -> int:
        return self.starts[position] + offset

    def point_by_index(self, index: int) -> tuple[Charge, int]:
        p, o = self.coord_by_index(index)
        return self.segments[p][0], o

    def index_by_point(self, q: Charge, offset: int) -> int:
        return self.index_by_coord(self.position_by_charge(q), offset)

    def coord_by_point(self, q: Charge, offset: int) -> tuple[int, int]:
        return self.position_by_charge(q), offset

    def point_by_coord(self, position: int, offset: int) -> tuple[Charge, int]:
        return self.segments[position][0], offset


@dataclass(frozen=True)
class Schema:
    """Names and edges of a tensor, its symmetry, and whether it is complex. Edges are None where dimensions are open."""

    names: tuple[str, ...]
    edges: tuple[Edge | None, ...]
    symmetry: Symmetry = field(default=NO)
    is_complex: bool = False

    def __post_init__(self) -> None:
        if len(set(self.names)) != len(self.names):
            raise ValueError(f"edge names repeat: {self.names}")
        if len(self.names) != len(self.edges):
            raise ValueError("as many edges as names are needed")

    def edge(self, name: str) -> Edge | None:
        return self.edges[self.names.index(name)]

    def blocks(self) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """(segment positions, dimensions) of the blocks with total charge zero, row-major."""
        out = []
        for own in itertools.product(*(range(len(e.segments)) for e in self.edges)):
            if self.symmetry.add(*(e.segments[p][0] for e, p in zip(self.edges, own)), self.symmetry.zero) == self.symmetry.zero:
                out.append((own, tuple(e.segments[p][1] for e, p in zip(self.edges, own))))
        return out

    @property
    def size(self) -> int:
        total = 0
        for _, dims in self.blocks():
            n = 1
            for d in dims:
                n *= d
            total += n
        return total


def merged(edges: list[Edge], symmetry: Symmetry) -> tuple[Edge, dict[tuple[int, ...], int]]:
    """The edge that packs `edges`, and where each combination of segments begins in it.

    Charges stand in the order in which row-major enumeration first meets them; inside a charge, combinations follow each
    other in that order.
    """
    combos: dict[Charge, list[tuple[tuple[int, ...], int]]] = {}
    for own in itertools.product(*(range(len(e.segments)) for e in edges)):
        q, n = symmetry.add(symmetry.zero, *(e.segments[p][0] for e, p in zip(edges, own))), 1
        for e, p in zip(edges, own):
            n *= e.segments[p][1]
        combos.setdefault(q, []).append((own, n))
    base, at, segments = {}, 0, []
    for q, parts in combos.items():
        start = at
        for own, n in parts:
            base[own] = at
            at += n
        segments.append((q, at - start))
    return Edge(tuple(segments), edges[0].arrow if edges else False), base
