"""Operators of single fermions as tensors with charges, and how to put operators of several sites together.

An operator has an edge O<i> out of and I<i> into each site; T carries the charge that it adds to the state.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from ..functions.symmetry import FERMI_U1, Edge, Symmetry
from .tensor import Tensor

#: States of a site with at most one fermion, seen from outside and from inside.
OUT, IN = Edge.of({0: 1, 1: 1}), Edge.of({0: 1, -1: 1}, True)


def rename_io(t: Tensor, sites: Iterable[int]) -> Tensor:
    """O0, I0, O1, ... become the edges of the given sites."""
    return t.edge_rename({f"{x}{i}": f"{x}{s}" for i, s in enumerate(sites) for x in "OI" if f"{x}{i}" in t.names and i != s})


def kronecker_product(*tensors: Tensor) -> Tensor:
    out = tensors[0]
    for t in tensors[1:]:
        out = out.contract(t, [])
    return out


def half_reverse(t: Tensor) -> Tensor:
    """The operator of the conjugate states: all edges with an arrow are reversed, those of O with their sign."""
    names = [n for n in t.names if t.schema.edge(n).arrow]
    return t.reverse_edge(names, False, [n for n in names if n.startswith("O")])


def creator(spark: SparkSession) -> Tensor:
    return Tensor.range_(spark, ["O0", "I0", "T"], [OUT, IN, Edge.of({-1: 1})], FERMI_U1, 1, 0)


def destroyer(spark: SparkSession) -> Tensor:
    return Tensor.range_(spark, ["O0", "I0", "T"], [OUT, IN, Edge.of({1: 1}, True)], FERMI_U1, 1, 0)


def unit(spark: SparkSession, symmetry: Symmetry = FERMI_U1) -> Tensor:
    return Tensor.identity(spark, [("I0", "O0", IN)], symmetry).transpose(["O0", "I0"])


def number(spark: SparkSession) -> Tensor:
    return creator(spark).contract(destroyer(spark), [("T", "T"), ("I0", "O0")])


def hop(spark: SparkSession, a: int = 0, b: int = 1) -> Tensor:
    """A fermion goes from site b to site a."""
    return rename_io(creator(spark), [a]).contract(rename_io(destroyer(spark), [b]), [("T", "T")])


def hopping(spark: SparkSession) -> Tensor:
    """Both ways between sites 0 and 1."""
    return hop(spark, 0, 1) + hop(spark, 1, 0)
