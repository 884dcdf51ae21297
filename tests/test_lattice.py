"""Exact diagonalisation, sampling, simple update, text forms, the lazy graph, commands and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions.lazy import Copy, Node, Root
from loomframe.functions.symmetry import BOSE_U1, FERMI_U1, Edge
from loomframe.operators import estimators, lattice
from loomframe.operators.tensor import Tensor
from loomframe.plans import models
from loomframe.plans.shell import Shell
from loomframe.sources import text
from loomframe.streaming.observer import windowed


def lowest(state):
    return np.linalg.eigvalsh(state.matrix())[0] / state.site_number


def test_ground_state_is_the_matrix(spark):
    state = models.heisenberg(2, 2)
    energy, v = state.ground_state(spark, 6, seed=1)
    assert energy == pytest.approx(lowest(state), abs=1e-6) and energy == pytest.approx(-0.5, abs=1e-6)
    # Ergodic sampling with all configurations gives the exact energy.
    samples = state.local_energies(spark, state.ergodic(spark), lattice.amplitudes(v))
    out = estimators.observe(samples.withColumn("g", F.lit(1)), ["g"], F.col("r"), F.col("e")).first()
    assert out["expect"] / 4 == pytest.approx(energy, abs=1e-6)
    table = {tuple(r["c"]): r["amplitude"] for r in lattice.amplitudes(v).collect()}
    chains = lattice.sweep(spark, state, table, 2, 3, lambda c: [0, 1, 1, 0], seed=5)
    assert chains.count() == 6 and all(sum(r["c"]) == 2 for r in chains.collect())


def test_models_are_hermitian():
    for name in ("ising", "heisenberg", "J1J2", "kitaev", "toric_code", "rydberg", "free_fermion", "gibbs_heisenberg"):
        state = models.find(name)(2, 2)
        state.check_hermite()
        assert state.terms
    assert lowest(models.free_fermion(1, 2)) == pytest.approx(-0.5)


def test_terms_are_sorted_added_and_repeats_contracted():
    s = lattice.State(1, 2)
    s.set_physics(2)
    a = np.arange(16.0).reshape(4, 4)
    s.add([(0, 1, 0), (0, 0, 0)], a)
    swapped = a.reshape(2, 2, 2, 2).transpose(1, 0, 3, 2).reshape(4, 4)
    assert np.allclose(s.terms[(0, 0, 0), (0, 1, 0)], swapped)
    s.add([(0, 0, 0), (0, 1, 0)], swapped)
    assert np.allclose(s.terms[(0, 0, 0), (0, 1, 0)], 2 * swapped)
    x, y = np.random.default_rng(0).normal(size=(2, 2, 2))
    s.add([(0, 0, 0), (0, 0, 0)], np.kron(x, y))
    assert np.allclose(s.terms[((0, 0, 0),)], x @ y)


def test_bundles_share_no_site():
    groups = lattice.bundles(sorted(models.heisenberg(3, 3).terms))
    assert sum(map(len, groups)) == 12
    for g in groups:
        sites = [p[:2] for key in g for p in key]
        assert len(sites) == len(set(sites))


def test_simple_update(spark):
    out = Shell(spark).run("seed 3\nsu_create heisenberg 1 2 D=2 # one bond\nsu_update 6 0.5 \\\n 2\nsu_energy\nsu_to_ex\nex_energy\nexit\nsu_energy")
    assert len(out) == 6 and out[3] == pytest.approx(-0.375, abs=1e-3) and out[5] == pytest.approx(out[3], abs=1e-9)


def test_text_and_bytes(spark, tmp_path):
    t = Tensor.range_(spark, ["Left", "Right"], [3, 4])
    assert text.show(t) == "{names:[Left,Right],edges:[3,4],blocks:[0,1,2,3,4,5,6,7,8,9,10,11]}"
    assert text.show(text.parse(spark, "\x1b[32m" + text.show(t))) == text.show(t)
    for symmetry in (BOSE_U1, FERMI_U1):
        u = Tensor.range_(spark, "abc", [Edge.of({-1: 3, 0: 1, 1: 2}, symmetry.is_fermi), Edge.of({-1: 1, 0: 2, 1: 3}), Edge.of({-1: 2, 0: 3, 1: 1})], symmetry, 7)
        assert text.show(text.parse(spark, text.show(u), symmetry)) == text.show(u)
        assert text.show(text.loads(spark, text.dumps(u))) == text.show(u)
        text.write_tensor(u, str(tmp_path / "t"))
        assert text.show(text.read_tensor(spark, str(tmp_path / "t"))) == text.show(u)
    for s, x in {"1.5": 1.5, "2i": 2j, "1-2i": 1 - 2j, "-i": -1j, "1e-05+3i": 1e-5 + 3j}.items():
        assert text.parse_number(s) == x


def test_configurations(spark, tmp_path):
    rows = spark.createDataFrame([(c, 0, 0, 0, c) for c in range(2)], "chain_id long, l1 int, l2 int, orbit int, idx int")
    text.write_configurations(rows, str(tmp_path / "c"))
    assert sorted((r["chain_id"], r["idx"]) for r in text.read_configurations(spark, str(tmp_path / "c"), 3).collect()) == [(0, 0), (1, 1), (2, 0)]


def test_nodes():
    calls = []
    a, b = Root(1), Root(2)
    c = Node(lambda x, y: calls.append(1) or x + y, a, b)
    assert not c and c() == 3 and c() == 3 and len(calls) == 1
    a.reset(1)
    assert c
    copy = Copy()
    a2, c2 = copy(a), copy(c)
    assert c2 and c2() == 3 and len(calls) == 1
    a.reset(4)
    assert not c and c() == 6 and len(calls) == 2 and c2() == 3
    b.reset(0)
    assert c2() == 1 and a2() == 1
    deep = a
    for _ in range(3000):
        deep = Node(lambda x: x + 1, deep)
    assert deep() == 3004


def test_windowed_observer_streams(spark, tmp_path):
    events = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 60) ts, id % 2 g, double(id % 5 + 1) r, double(id) e from range(100)")
    events.write.parquet(str(tmp_path / "in"))
    flat = lambda rows: {(r["window"].start, r["g"], k): r[k] for r in rows for k in ("expect", "dev")}
    batch = flat(windowed(events, "ts", "10 minutes", ["g"], F.col("r"), F.col("e")).collect())
    stream = windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "10 minutes", ["g"], F.col("r"), F.col("e"), "1 minute")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("observed").start()
    q.processAllAvailable()
    q.stop()
    assert flat(spark.table("observed").collect()) == pytest.approx(batch)


def test_weighted_estimates(spark):
    r = np.random.default_rng(2)
    w, e, d = r.random(50), r.normal(size=50), r.normal(size=50)
    rows = spark.createDataFrame([(i, 0, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(w, e, d))], "s long, p long, r double, e double, d double")
    out = estimators.observe(rows, ["p"], F.col("r"), F.col("e")).first()
    mean = (w * e).sum() / w.sum()
    assert out["expect"] == pytest.approx(mean) and out["dev"] == pytest.approx(np.sqrt((w**2 * (e - mean) ** 2).sum()) / w.sum())
    g = estimators.gradient(rows, ["p"], F.col("r"), F.col("e"), F.col("d")).first()["g"]
    assert g == pytest.approx(2 * ((w * e * d).sum() / w.sum() - mean * (w * d).sum() / w.sum()))
    x = estimators.conjugate_gradient(rows, "s", "p", "d", "e", 3)
    assert x[0] == pytest.approx((d * e).sum() / (d * d).sum())


def test_dense_matrices(spark):
    from loomframe.operators.dense import Dense, pseudo_inverse_direction

    r = np.random.default_rng(7)
    x, y = r.normal(size=(7, 10)), r.normal(size=(10, 5))
    a, b = Dense.of(spark, x, 4), Dense.of(spark, y, 4)
    assert np.allclose(a.multiply(b).local(), x @ y)
    assert np.allclose(a.redistribute(3).local(), x)
    assert np.allclose(a.multiply_vector(y[:, 0]), x @ y[:, 0])
    assert np.allclose(pseudo_inverse_direction(a, x[:, 0]), x.T @ np.linalg.pinv(x @ x.T) @ x[:, 0], atol=1e-8)


def test_fermion_terms(spark):
    from loomframe.sources.terms import state_from_terms

    rows = [([0, 1], [True, False], 1.0), ([1, 0], [True, False], 0.5), ([1, 0], [True, False], 0.5), ([0, 0], [True, False], 1e-9)]
    terms = spark.createDataFrame(rows, "sites array<int>, daggers array<boolean>, coefficient double")
    state = state_from_terms(terms, 1, 2, 1e-6)
    assert np.allclose(np.linalg.eigvalsh(state.matrix()), [-1, 0, 0, 1])
    with pytest.raises(ValueError):
        state_from_terms(spark.createDataFrame([([0], [True], 1.0)], terms.schema), 1, 2)


def test_parameters(spark, tmp_path):
    from loomframe.sources.parameters import parse_parameters, read_parameters

    body = "****\n****length_and_type           2           real*8\n****Below\nt   -1\nU  12\n****length_and_type  1 integer\n  L1   4\n  dims 2 3\n"
    assert parse_parameters(body) == {"t": -1.0, "U": 12.0, "L1": 4, "dims": [2, 3]}
    (tmp_path / "p.dat").write_text(body)
    assert {r["name"]: r["value"] for r in read_parameters(spark, str(tmp_path)).collect()} == {"t": "-1.0", "U": "12.0", "L1": "4", "dims": "[2, 3]"}
