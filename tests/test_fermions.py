"""Fermion lattices against dense matrices, and the arithmetic of complex and sparse tensors against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions.symmetry import BOSE_U1, NO, Edge, Schema
from loomframe.operators import fermions, linear_algebra
from loomframe.operators.tensor import Tensor, safe_contract, safe_rename
from loomframe.plans import models


def dense(m):
    """The matrix in the allowed states, from products of the modes' own matrices."""
    down, z = np.array([[0, 1], [0, 0]]), np.diag([1, -1])

    def destroy(k):
        out = np.eye(1)
        for j in range(m.modes - 1, -1, -1):
            out = np.kron(out, z if j < k else down if j == k else np.eye(2))
        return out

    h = np.zeros((2**m.modes, 2**m.modes))
    for operators, c in m.strings.items():
        a = np.eye(2**m.modes)
        for k, creates in operators:
            a = a @ (destroy(k).T if creates else destroy(k))
        h += c * a
    count = lambda i, g: sum(i >> k & 1 for k in g)
    ok = [i for i in range(2**m.modes) if all(count(i, g) == n for g, n in m.conserved) and all(count(i, g) <= 1 for g in m.exclusive)]
    return h[np.ix_(ok, ok)], ok


@pytest.mark.parametrize("lattice", [fermions.hubbard(1, 3, 3, 1, 4), fermions.tJ(2, 2, 3), fermions.bcs(2, 2, 1, 0.7, 0.3), fermions.tV(2, 2, 2, 1, 2), fermions.honeycomb_hubbard(2, 1, 2)], ids=lambda x: f"{x.modes} modes")
def test_apply_is_the_matrix(spark, lattice):
    lattice.check_hermite()
    h, states = dense(lattice)
    assert np.allclose(h, h.T)
    v = lattice.random_vector(spark, 3)
    x = {r["e_s"]: r["re"] for r in v.df.collect()}
    assert sorted(x) == states
    got = {r["e_s"]: r["re"] for r in lattice.apply(v).df.collect()}
    assert np.allclose([got.get(s, 0.0) for s in states], h @ [x[s] for s in states])


def test_strings():
    m = fermions.FermionLattice(3, 3)
    m.add(1.5, fermions.creates(0), fermions.destroys(1))
    with pytest.raises(ValueError):
        m.check_hermite()
    m.add(1.5, fermions.creates(1), fermions.destroys(0))
    m.check_hermite()
    m.add(-1.5, fermions.creates(1), fermions.destroys(0))
    assert len(m.strings) == 1
    assert fermions.normal_ordered({((0, False), (0, True)): 1.0}) == {(): 1.0, ((0, True), (0, False)): -1.0}
    with pytest.raises(ValueError):
        m.add(1.0, fermions.creates(7))


def test_published_energy(spark):
    energy, v = fermions.free_fermion(3, 3, 4).ground_state(spark, 18)
    assert energy == pytest.approx(-0.6285393610547229, abs=1e-10)
    assert fermions.free_fermion(3, 3, 4).observe(v, {(fermions.creates(4), fermions.destroys(4)): 1.0}) <= 1


def test_complex_and_sparse_arithmetic(spark):
    r = np.random.default_rng(1)
    a, b = (r.normal(size=4) + 1j * r.normal(size=4) for _ in range(2))
    make = lambda x: Tensor(spark.createDataFrame([(i, float(v.real), float(v.imag)) for i, v in enumerate(x)], "e_i long, re double, im double"), Schema(("i",), (Edge.plain(len(x)),), NO, True))
    read = lambda t: np.array([complex(r["re"], r["im"]) for r in t.df.orderBy("e_i").collect()])
    x, y = make(a), make(b)
    for got, want in ((x * y, a * b), (x / y, a / b), (x.reciprocal(), 1 / a), (1j - x, 1j - a), (x + (2 - 1j), a + 2 - 1j), (2 / x, 2 / a), (x * (1 + 2j), a * (1 + 2j)), (x.sqrt(), np.sqrt(abs(a))), (-x, -a), (x / 2, a / 2)):
        assert np.allclose(read(got), want)
    assert np.allclose(read(make(np.array([0, 1 + 2j])).reciprocal()), [0, 0.2 - 0.4j])
    sparse = Tensor(spark.createDataFrame([(1, 3.0)], "e_i long, re double"), Schema(("i",), (Edge.plain(3),), NO))
    real = lambda t: [r["re"] for r in t.df.orderBy("e_i").collect()]
    assert real(sparse + 2) == [2, 5, 2] and real(1 - sparse) == [1, -2, 1] and real(6 / sparse) == [np.inf, 2, np.inf]
    with pytest.raises(ValueError):
        Tensor.from_table(spark.range(3), {"i": "id"}, "id") + 1
    assert sparse.with_element({"i": 2}, 4.5).element({"i": 2}).first()["re"] == 4.5
    u = Edge.of({-1: 2, 0: 1, 1: 2})
    t = Tensor.range_(spark, "ab", [u, u], BOSE_U1, 1)
    with pytest.raises(ValueError):
        t.with_element({"a": 0, "b": 0}, 1)
    block = t.block({"a": (-1,), "b": (1,)})
    assert block.norms().first()["n_num"] == 4
    again = t.with_block({"a": (-1,), "b": (1,)}, block * 2)
    assert again.norms().first()["n_sum"] == t.norms().first()["n_sum"] + block.norms().first()["n_sum"]
    z = Tensor.random(spark, ["i"], [2000], mean=1, is_complex=True).df.agg(F.avg("re").alias("a"), F.avg("im").alias("b"), F.corr("re", "im").alias("c")).first()
    assert abs(z["a"] - 1) < 0.1 and abs(z["b"] - 1) < 0.1 and abs(z["c"]) < 0.1


def test_safe_names(spark):
    t = Tensor.range_(spark, ["a", "P0"], [2, 3])
    assert safe_rename(t, {"a": "x", "q": "r"}).names == ("x", "P0")
    out = safe_contract(t, Tensor.range_(spark, ["b", "P0"], [2, 3]), [("z", "z")], physics=True)
    assert out.names == ("a", "b") and [r["re"] for r in out.df.orderBy("e_a", "e_b").collect()] == [5, 14, 14, 50]


def test_tall_factors_of_any_group(spark):
    x = np.random.default_rng(2).normal(size=(500, 3))
    x[:, 2] = x[:, 0] - x[:, 1]
    rows = [("dependent", v.tolist()) for v in x] + [("one", [1.0, 2.0, 3.0])] + [("full", v.tolist()) for v in x + np.random.default_rng(3).normal(size=x.shape)]
    df = spark.createDataFrame(rows, "g string, row array<double>").repartition(5)
    got = {r["g"]: np.reshape(r["r"], (3, 3)) for r in linear_algebra.tall_qr(df, "g", "row", 3).collect()}
    for g, r in got.items():
        own = np.array([v for k, v in rows if k == g])
        assert np.allclose(r.T @ r, own.T @ own) and (np.diag(r) >= 0).all() and np.allclose(r, np.triu(r))
    values = linear_algebra.tall_singular_values(df, "g", "row").orderBy("g", "k").collect()
    for g in got:
        own = np.linalg.svd(np.array([v for k, v in rows if k == g]), compute_uv=False)
        assert np.allclose([r["s"] for r in values if r["g"] == g], own)
    assert linear_algebra.tall_qr(df.limit(0), "g", "row", 3).count() == 0


def test_qr_by_the_edges_of_r(spark):
    t = Tensor.random(spark, ["a", "b"], [5, 3])
    q, r = linear_algebra.qr(t, ["b"], "x", "y", "r")
    assert q.names == ("a", "x") and r.names == ("y", "b")
    assert (q.contract(r, [("x", "y")]) - t).norms().first()["n_max"] < 1e-12


def test_unsupported_lattices_are_refused():
    from loomframe.operators.sampling import SamplingLattice

    with pytest.raises(NotImplementedError):
        SamplingLattice.create(models.find("kitaev")(2, 2), 2)
    for name, sizes in (("kagome_heisenberg", (2, 2)), ("cluster_heisenberg", (2, 4, 2, 2)), ("gibbs_J1J2", (2, 2)), ("boson_metal", (2, 2))):
        state = models.find(name)(*sizes)
        state.check_hermite()
        assert state.terms
    lattice = models.find("cluster_heisenberg")(2, 4, 2, 2)
    whole = models.find("heisenberg")(2, 4)
    assert np.allclose(np.linalg.eigvalsh(lattice.matrix()), np.linalg.eigvalsh(whole.matrix()))


def test_operators_of_single_fermions(spark):
    from loomframe.operators import toolkit

    read = lambda t: {tuple(r[k] for k in t.keys): r["re"] for r in t.nonzero().df.collect()}
    assert read(toolkit.number(spark)) == {(1, 1): 1.0} and read(toolkit.unit(spark)) == {(0, 0): 1.0, (1, 1): 1.0}
    there_and_back = toolkit.hop(spark, 0, 1).contract(toolkit.hop(spark, 1, 0), [("I0", "O0"), ("I1", "O1")]).transpose(["O0", "O1", "I0", "I1"])
    assert read(there_and_back) == {(1, 0, 1, 0): 1.0}  # n (1 - n)
    two = toolkit.kronecker_product(toolkit.number(spark), toolkit.rename_io(toolkit.number(spark), [1]))
    assert two.names == ("O0", "I0", "O1", "I1") and read(two) == {(1, 1, 1, 1): 1.0}
    assert read(two.transpose(["O0", "O1", "I0", "I1"])) == {(1, 1, 1, 1): -1.0}  # two odd edges changed places
    assert read(toolkit.half_reverse(toolkit.half_reverse(toolkit.number(spark)))) == {(1, 1): 1.0}


def test_energies_by_bond_weights(spark):
    """On a chain the weights are the environment, once they have settled."""
    from loomframe.operators.simple_update import SimpleUpdate

    su = SimpleUpdate.create(spark, models.find("heisenberg")(1, 3, -1.0), 2, 1)
    su.update(6, 0.2, 2)
    su.update(4, 0.01, 2)
    assert su.environment_energy() == pytest.approx(su.energy(spark), abs=5e-3)
    one = su.observe({((0, 1, 0),): np.eye(2)})
    assert one[((0, 1, 0),)] == pytest.approx(1)


def test_directions_without_a_factor(spark):
    from loomframe.operators.dense import Dense, pseudo_inverse_direction

    r = np.random.default_rng(4)
    a, e = r.normal(size=(7, 30)), r.normal(size=7)
    d = Dense.of(spark, a, 4)
    want = np.linalg.pinv(a) @ e
    assert np.allclose(pseudo_inverse_direction(d, e), want)
    assert np.allclose(pseudo_inverse_direction(d, e, largest=3), want)


def test_distant_terms_are_updated(spark):
    """Without a cut, swaps and all, a step is the product of the exact exponentials."""
    from loomframe.operators.lattice import SZ, State, product
    from loomframe.operators.linear_algebra import expm
    from loomframe.operators.simple_update import SimpleUpdate

    state = State(2, 2)
    state.set_physics(2)
    rng = np.random.default_rng(6)
    h = rng.normal(size=(4, 4))
    state.add([(0, 0, 0), (1, 1, 0)], h + h.T)
    state.add([(0, 1, 0), (1, 0, 0)], product(SZ, SZ) + np.diag([0.1, 0.2, 0.3, 0.4]))
    su = SimpleUpdate.create(spark, state, 1, 2)
    vector = lambda t: np.array([r["re"] for r in t.df.orderBy(*sorted(t.keys)).collect()])
    before = vector(su.to_exact(spark))
    su.update(1, 0.3, 64)
    want = expm(-0.6 * state.matrix()) @ before  # the two terms share no site, and each acts twice
    assert np.allclose(vector(su.to_exact(spark)), want / np.linalg.norm(want))
    with pytest.raises(NotImplementedError):
        three = State(1, 3)
        three.set_physics(2)
        three.add([(0, i, 0) for i in range(3)], np.eye(8))
        SimpleUpdate.create(spark, three, 1).update(1, 0.1, 2)
