"""Networks against finite differences and their dense states; sampling and descent of neural states."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import neural
from loomframe.operators.lattice import SY
from loomframe.operators.neural import Autoregressive, NeuralState
from loomframe.operators.sampling import SamplingLattice
from loomframe.plans import models
from loomframe.plans.shell import Shell


def configurations(network):
    return np.array(list(itertools.product(*(range(d) for d in network.dims))))


def made(name, state, **options):
    return neural.NETWORKS[name](state, seed=3, **options)


CASES = [("table", {}), ("chain", {"bond": 3}), ("convolution", {"channels": 3}), ("convolution", {"staggered": True}), ("autoregressive", {"hidden": 3}), ("autoregressive", {"hidden": 3, "counts": [2, 2]})]


@pytest.mark.parametrize("name, options", CASES)
def test_deltas_are_derivatives(name, options):
    network = made(name, models.find("heisenberg")(2, 2), **options)
    c = configurations(network)
    ws = network.amplitude(c)
    c, ws = c[ws != 0], ws[ws != 0]
    got = network.deltas(c, ws)
    want = []
    for n in sorted(network.parameters):
        flat = network.parameters[n].reshape(-1)
        for i in range(flat.size):
            keep, sides = flat[i], []
            for shift in (1e-6, -1e-6):
                flat[i] = keep + shift
                sides.append(network.amplitude(c))
            flat[i] = keep
            want.append((sides[0] - sides[1]) / 2e-6 / ws)
    assert np.allclose(got, np.array(want).T, atol=1e-5)


def test_autoregressive_draws():
    """Squared amplitudes add up to one, masked ones keep their counts, and draws are distinct and follow them."""
    for counts in (None, [4, 2]):
        network = made("autoregressive", models.find("heisenberg")(2, 3), counts=counts)
        every = configurations(network)
        p = network.amplitude(every) ** 2
        assert p.sum() == pytest.approx(1)
        if counts:
            assert set(every[p > 0].sum(axis=1)) == {2}
        c, m = network.generate(200_000, np.random.default_rng(1))
        assert m.sum() == 200_000 and m.min() > 0 and len(np.unique(c, axis=0)) == len(c)
        share = dict(zip(map(tuple, c.tolist()), m / 200_000))
        assert max(abs(share.get(tuple(x), 0) - q) for x, q in zip(every.tolist(), p)) < 0.01
        assert network.generate(10**12, np.random.default_rng(1))[1].sum() == 10**12
    with pytest.raises(ValueError):
        Autoregressive(models.find("heisenberg")(2, 2), counts=[1, 1])
    with pytest.raises(NotImplementedError):
        made("chain", models.find("heisenberg")(2, 2)).generate(3, np.random.default_rng(0))


def dense(lattice):
    v = lattice.network.amplitude(configurations(lattice.network))
    return v @ lattice.state.matrix() @ v / (v @ v) / lattice.state.site_number


@pytest.mark.parametrize("name, options", CASES[1:5])
def test_energy_and_gradient(spark, name, options):
    """All configurations give the dense state's energy, and its derivatives."""
    lattice = NeuralState.create(models.find("ising")(2, 2), name, seed=3, **options)
    rows = lattice.observe(spark, "ergodic", 3, 0)
    assert lattice.energy(rows)[0] == pytest.approx(dense(lattice))
    g = lattice.gradient(rows)
    for n, at in lattice.offsets().items():
        flat = lattice.tensors[n].reshape(-1)
        keep, sides = flat[0], []
        for shift in (1e-5, -1e-5):
            flat[0] = keep + shift
            sides.append(dense(lattice))
        flat[0] = keep
        assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-5 * lattice.state.site_number, abs=1e-6)


def test_samples_agree_with_all_configurations(spark):
    lattice = NeuralState.create(models.find("heisenberg")(2, 2), "autoregressive", counts=[2, 2], seed=3)
    want = dense(lattice)
    direct = lattice.observe(spark, "direct", 4, 50_000, seed=1, deltas=False)
    assert direct.agg(F.sum("m")).first()[0] == 200_000 and direct.count() <= 4 * 6
    assert lattice.energy(direct)[0] == pytest.approx(want, abs=0.01)
    swept = lattice.observe(spark, "sweep", 8, 300, seed=2, deltas=False, start=lambda _: [0, 1, 1, 0], equilibrate=5)
    assert swept.count() == 2400 and lattice.energy(swept)[0] == pytest.approx(want, abs=0.05)
    again = lattice.observe(spark, "sweep", 8, 300, seed=2, deltas=False, start=lambda _: [0, 1, 1, 0], equilibrate=5).repartition(1)
    assert again.exceptAll(swept).count() == 0
    free = NeuralState.create(models.find("heisenberg")(2, 2), "chain", seed=3)
    half = free.observe(spark, "ergodic", 2, 0, restrict=lambda c: c.sum(axis=1) == 2)
    assert half.count() == 6 and {sum(r["c"]) for r in half.collect()} == {2}


def test_descent_and_weights(spark, tmp_path):
    lattice = NeuralState.create(models.find("ising")(2, 2), "convolution", seed=3)
    lowest = np.linalg.eigvalsh(lattice.state.matrix())[0] / 4
    found = [e for e, _ in lattice.descend(spark, 6, 0.1, "ergodic", 2, 0, natural=True)]
    assert found[-1] < found[0] and found[-1] >= lowest - 1e-9
    c = configurations(lattice.network)
    neural.write_weights(spark, lattice.network, str(tmp_path / "w"))
    other = NeuralState.create(lattice.state, "convolution", seed=9)
    neural.read_weights(spark, other.network, str(tmp_path / "w"))
    assert np.array_equal(other.network.amplitude(c), lattice.network.amplitude(c))
    with pytest.raises(ValueError):
        neural.read_weights(spark, made("convolution", lattice.state, channels=2), str(tmp_path / "w"))
    lattice.state.add([(0, 0, 0)], SY)
    with pytest.raises(NotImplementedError):
        lattice.terms()


def test_two_orbits(spark):
    """Models with several orbits a site run, for configurations are by point."""
    lattice = NeuralState.create(models.find("kitaev")(1, 2), "chain", seed=3)
    assert len(lattice.network.dims) > 2
    assert lattice.energy(lattice.observe(spark, "ergodic", 2, 0, deltas=False))[0] == pytest.approx(dense(lattice))


def test_commands(spark, tmp_path):
    out = Shell(spark).run(f"seed 2\nnn_create ising 2 2\nnn_network_create chain bond=2\nnn_conf_create neel\nnn_run 20 2 0.01 relative=True\nnn_network_dump {tmp_path}/w\nnn_network_load {tmp_path}/w\nnn_run 0 1 0.01 sampling=ergodic")
    assert len(out[4]) == 2 and len(out[7]) == 1


def test_same_samples(spark):
    """Samples seen again are the same, and a line search on them finds a rate that lowers the energy; steps with random
    sizes, and stops."""
    lattice = NeuralState.create(models.find("ising")(2, 2), "chain", bond=2, seed=3)
    sites = SamplingLattice.create(models.find("ising")(2, 2), 2, seed=3)
    for each in (lattice, sites):
        rows = each.observe(spark, "ergodic", 2, 0)
        again = each.observe_again(spark, rows)
        near = again.alias("a").join(rows.alias("b"), "sample_id").filter("abs(a.e - b.e) < 1e-9 and abs(a.r - b.r) < 1e-9")
        assert near.count() == rows.count() == 16
    g = sites.gradient(rows)
    rate, before = sites.line_search(rows, g, 64.0), sites.energy(rows)[0]
    sites.apply(g * rate)
    assert rate < 64 and sites.energy(sites.observe_again(spark, rows))[0] < before
    assert len(list(lattice.descend(spark, 3, 0.01, "ergodic", 2, 0, random=True, search=True))) == 3
    asked = iter([False, True])
    assert len(list(lattice.descend(spark, 3, 0.01, "ergodic", 2, 0, stop=lambda: next(asked)))) == 1


def test_natural_gradient(spark):
    """Against the dense metric of centred deltas."""
    for lattice in (NeuralState.create(models.find("ising")(2, 2), "table", seed=3), NeuralState.create(models.find("ising")(2, 2), "autoregressive", hidden=2, seed=3)):
        c = configurations(lattice.network)
        ws = lattice.network.amplitude(c)
        w, d = ws**2 / (ws @ ws), lattice.network.deltas(c, ws)
        e = lattice.state.matrix() @ ws / ws
        d, e = d - w @ d, e - w @ e
        metric = d.T @ (w[:, None] * d)
        shift = 1e-2 * np.trace(metric) / len(metric)
        want = 2 * np.linalg.solve(metric + shift * np.eye(len(metric)), d.T @ (w * e))
        got = lattice.natural_gradient(lattice.observe(spark, "ergodic", 2, 0), 60)
        assert np.allclose(got, want, atol=1e-4 * np.abs(want).max())
