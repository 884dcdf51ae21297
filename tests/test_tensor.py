"""Goldens, algebraic identities and random comparisons with numpy for the tensor operators."""

import numpy as np
import pytest

from loomframe.functions.symmetry import BOSE_U1, FERMI_U1, FERMI_Z2, Edge, Schema, merged
from loomframe.operators import linear_algebra as L
from loomframe.operators.tensor import Tensor, chain


def array(t):
    """The dense numpy array over total indices."""
    a = np.zeros([e.dimension for e in t.schema.edges], complex if t.schema.is_complex else float)
    for r in t.df.collect():
        a[tuple(int(r[k]) for k in t.keys)] += r["re"] + (1j * r["im"] if t.schema.is_complex else 0)
    return a


def sparse(spark, a, names, symmetry=None, edges=None):
    rows = [(*map(int, i), float(a[i])) for i in np.ndindex(a.shape)]
    df = spark.createDataFrame(rows, ", ".join([f"e_{n} long" for n in names] + ["re double"]))
    return Tensor(df, Schema(tuple(names), tuple(edges or map(Edge.plain, a.shape)), *([symmetry] if symmetry else [])))


def test_contract_goldens(spark):
    a, b = Tensor.range_(spark, "AB", [2, 2]), Tensor.range_(spark, "CD", [2, 2])
    # Fixed values.
    golden = {"AC": [4, 6, 6, 10], "AD": [2, 6, 3, 11], "BC": [2, 3, 6, 11], "BD": [1, 3, 3, 13]}
    for (x, y), want in golden.items():
        assert array(a.contract(b, [(x, y)])).ravel().tolist() == want
    a, b = Tensor.range_(spark, "ABCD", [1, 2, 3, 4]), Tensor.range_(spark, "EFGH", [3, 1, 2, 4])
    out = a.contract(b, [("B", "G"), ("D", "H")])
    assert out.names == ("A", "C", "E", "F")
    assert array(out).ravel().tolist() == [316, 796, 1276, 428, 1164, 1900, 540, 1532, 2524]


def test_contract_and_trace_against_numpy(spark):
    r = np.random.default_rng(0)
    x, y = r.normal(size=(3, 2, 4)), r.normal(size=(4, 3, 2))
    a, b = sparse(spark, x, "abc"), sparse(spark, y, "cde")
    assert np.allclose(array(a.contract(b, [("c", "c"), ("a", "d")])), np.einsum("abc,cae->be", x, y))
    assert np.allclose(array(a.contract(b.edge_rename({"d": "a"}), [("b", "e")], fuse=["c", "a"])), np.einsum("abc,cab->ca", x, y))
    z = sparse(spark, r.normal(size=(3, 2, 3, 2, 2)), "abcde")
    assert np.allclose(array(z.trace([("a", "c")], {"f": ("b", "d")})), np.einsum("abcde,ac,bd->be", array(z), np.eye(3), np.eye(2)))
    t = chain([a, b.edge_rename({"c": "f"})], [(0, "c", 1, "f"), (0, "a", 1, "d")])
    assert np.allclose(sorted(array(t).ravel()), sorted(np.einsum("abc,cae->be", x, y).ravel()))


def test_norms_and_blocks(spark):
    edges = [Edge.of({-1: 3, 0: 1, 1: 2}), Edge.of({-1: 1, 0: 2, 1: 3}), Edge.of({-1: 2, 0: 3, 1: 1})]
    t = Tensor.range_(spark, ["l", "r", "u"], edges, BOSE_U1, 7)
    n = t.norms().first()
    # Fixed values.
    assert t.schema.size == 60 and (n["n_max"], n["n_num"], n["n_sum"]) == (66, 60, 2190)
    assert n["n_2"] == pytest.approx(np.sqrt(sum(k * k for k in range(7, 67))))
    assert Tensor.scalar(spark, 2333).item() == 2333


def u1(arrow=False, flip=False):
    return Edge.of({1: 2, 0: 2, -1: 2} if flip else {-1: 2, 0: 2, 1: 2}, arrow)


def test_symmetric_contract_equals_cleared(spark):
    a = Tensor.range_(spark, "ABCD", [u1(), u1(flip=True), u1(), u1(flip=True)], BOSE_U1)
    b = Tensor.range_(spark, "EFGH", [u1(), u1(flip=True), u1(), u1(flip=True)], BOSE_U1)
    for pairs in ([("B", "E")], [("A", "F"), ("D", "G")]):
        assert np.allclose(array(a.contract(b, pairs)), array(a.clear_symmetry().contract(b.clear_symmetry(), pairs)))


def test_fermi_identities(spark):
    a = Tensor.range_(spark, "ABCD", [u1(True), u1(False, True), u1(True), u1(True, True)], FERMI_U1)
    b = Tensor.range_(spark, "EFGH", [u1(False), u1(False, True), u1(True), u1(False, True)], FERMI_U1)
    pairs = [("A", "F"), ("C", "H")]
    ab, ba = a.contract(b, pairs), b.contract(a, [(y, x) for x, y in pairs])
    assert np.allclose(array(ab), array(ba.transpose(ab.names)))
    assert np.allclose(array(a.transpose("DBAC").contract(b.transpose("HFEG"), pairs).transpose(ab.names)), array(ab))
    c = a.contract(b, []).trace(pairs)
    assert np.allclose(array(c.transpose(ab.names)), array(ab))
    one = a.contract(b, []).trace(pairs[:1]).trace(pairs[1:])
    assert np.allclose(array(one.transpose(ab.names)), array(ab))
    assert np.allclose(array(a.conjugate().conjugate()), array(a))
    # Reversing a bond with the sign on one side changes nothing.
    x = a.reverse_edge(["A"], False, ["A"]).contract(b.reverse_edge(["F"]), pairs)
    assert np.allclose(array(x), array(ab))


def test_merge_then_contract_fermi(spark):
    a = Tensor.range_(spark, "ABCD", [u1(False), u1(False, True), u1(False), u1(True, True)], FERMI_U1)
    b = Tensor.range_(spark, "EFGH", [u1(True), u1(False, True), u1(True), u1(True, True)], FERMI_U1)
    plain = a.contract(b, [("B", "E"), ("A", "H")])
    # Both sides are packed in the same order, with the sign on one of them.
    packed = a.merge_edge({"m": ["B", "A"]}, False, ["m"]).contract(b.merge_edge({"n": ["E", "H"]}), [("m", "n")])
    assert np.allclose(array(packed.transpose(plain.names)), array(plain))


def test_merge_split_round_trip(spark):
    edges = [u1(), u1(flip=True), Edge.of({-1: 1, 0: 2, 1: 1})]
    t = Tensor.range_(spark, "abc", edges, BOSE_U1, 1)
    m = t.merge_edge({"m": ["a", "b"]})
    edge, base = merged(edges[:2], BOSE_U1)
    assert m.names == ("m", "c") and m.schema.edge("m") == edge and edge.dimension == 36 and len(base) == 9
    assert np.allclose(array(m.split_edge({"m": [("a", edges[0]), ("b", edges[1])]})), array(t))
    f = Tensor.range_(spark, "abc", [Edge(e.segments, False) for e in edges], FERMI_U1, 1)
    g = f.merge_edge({"m": ["a", "b"]}, False, ["m"]).split_edge({"m": [("a", edges[0]), ("b", edges[1])]}, False, ["m"])
    assert np.allclose(array(g), array(f))


def test_index_point_coord():
    e = Edge.of({1: 3, 0: 1, -2: 2})
    for i in range(6):
        assert e.index_by_coord(*e.coord_by_index(i)) == i and e.index_by_point(*e.point_by_index(i)) == i


def test_identity_shrink_expand_elementwise(spark):
    i = Tensor.identity(spark, [("a", "b", 3)])
    assert np.allclose(array(i), np.eye(3))
    f = Tensor.identity(spark, [("a", "b", u1(False))], FERMI_U1)
    t = Tensor.range_(spark, "xy", [u1(True, True), u1(False)], FERMI_U1, 1)
    assert np.allclose(array(t.contract(f, [("x", "a")]).edge_rename({"b": "x"}).transpose("xy")), array(t))
    t = Tensor.range_(spark, "ab", [2, 3])
    assert array(t.shrink({"a": 1})).tolist() == [3, 4, 5]
    assert array(t.shrink({"a": 1}).expand({"a": (0, 2)})).tolist() == [[3, 4, 5], [0, 0, 0]]
    assert np.allclose(array((t + t) * 2 - t), 3 * array(t))
    assert np.allclose(array(t.reciprocal()), np.where(array(t) == 0, 0, 1 / np.maximum(array(t), 1)))
    z = t.to("complex128")
    assert np.allclose(array(z.conjugate()), array(z).conj()) and not z.to("float64").schema.is_complex
    assert t.element({"a": 1, "b": 2}).first()["re"] == 5


def test_clear_fermi_symmetry(spark):
    t = Tensor.range_(spark, "ab", [Edge.of({1: 1, 0: 2, 2: 1}), Edge.of({-1: 1, 0: 2, -2: 1})], FERMI_U1, 1)
    c = t.clear_symmetry()
    assert c.schema.symmetry == FERMI_Z2 and [q for q, _ in c.schema.edge("a").segments] == [(0,), (1,)]
    assert sorted(array(c).ravel()) == sorted(array(t).ravel())


@pytest.mark.parametrize("cut", [-1, 2])
def test_svd_rebuilds(spark, cut):
    t = Tensor.range_(spark, "ABCD", [2, 3, 4, 5])
    u, s, v = L.svd(t, ["C", "A"], "cu", "cv", "su", "sv", cut)
    back = u.contract(s, [("cu", "su")]).contract(v, [("sv", "cv")]).transpose(t.names)
    assert np.abs(array(back) - array(t)).max() < 1e-8
    m = array(u).reshape(8, -1)
    assert np.allclose(m.T @ m, np.eye(m.shape[1]), atol=1e-8)


@pytest.mark.parametrize("symmetry", [BOSE_U1, FERMI_U1])
def test_svd_qr_symmetric(spark, symmetry):
    f = symmetry.is_fermi
    edges = [Edge.of({-1: 1, 0: 1, -2: 1}, f), Edge.of({0: 1, 1: 2}), Edge.of({0: 2, 1: 2}), Edge.of({-2: 2, -1: 1, 0: 2}, f)]
    t = Tensor.range_(spark, "ABCD", edges, symmetry, 1)
    u, s, v = L.svd(t, ["C", "A"], "cu", "cv", "su", "sv")
    assert np.abs(array(u.contract(s, [("cu", "su")]).contract(v, [("sv", "cv")]).transpose(t.names)) - array(t)).max() < 1e-8
    q, r = L.qr(t, ["B", "D"], "cq", "cr")
    assert np.abs(array(q.contract(r, [("cq", "cr")]).transpose(t.names)) - array(t)).max() < 1e-8


def test_svd_drops_zeros(spark):
    a = np.zeros((2, 2))
    a[0, 1] = 1
    _, s, _ = L.svd(sparse(spark, a, "ab"), ["a"], "cu", "cv", "su", "sv", 8)
    assert s.df.count() == 1


def test_exponential(spark):
    r = np.random.default_rng(1)
    a = r.normal(size=(4, 4))
    want, term = np.eye(4), np.eye(4)
    for k in range(1, 100):
        term = term @ a / k
        want = want + term
    assert np.abs(array(L.exponential(sparse(spark, a, "ij"), [("i", "j")], 10)) - want).max() < 1e-8


def test_validation(spark):
    t = Tensor.range_(spark, "ab", [2, 3])
    for wrong in (lambda: t.contract(t, [("a", "b")]), lambda: t.contract(t.edge_rename({"a": "c"}), [("a", "c")]), lambda: t.edge_rename({"z": "y"}), lambda: t.transpose("a")):
        with pytest.raises(ValueError):
            wrong()
